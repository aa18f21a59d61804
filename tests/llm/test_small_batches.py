"""The pipeline's stages hand long texts to Python in batches of bounded bytes."""

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import common

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def limits(spark):
    before = {k: spark.conf.getAll.get(k) for k in common.LIMITS}
    for k in common.LIMITS:
        spark.conf.unset(k)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def largest(docs):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    return docs.mapInArrow(run, "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("stage", [corpus_pipeline.language_id, corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages, corpus_pipeline.bpe])
def test_batches_of_long_texts_are_small(limits, stage):
    docs = limits.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("x " * 2500).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    assert largest(docs) > 2 * common.STEP_BYTES
    stage(limits, docs.limit(1), "")
    assert largest(docs) < 1.5 * common.STEP_BYTES


def test_the_session_s_own_limit_stays(limits):
    limits.conf.set(BYTES, "1m")
    common.small_batches(limits)
    assert limits.conf.get(BYTES) == "1m"
