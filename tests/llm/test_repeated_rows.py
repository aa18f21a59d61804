"""Repeated rows and null ids in the pipeline's stages."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from crosspanel.llm import mixing

LONG = " ".join(f"a{i}" for i in range(60))
OTHER = " ".join(f"b{i}" for i in range(60))
THIRD = " ".join(f"c{i}" for i in range(60))
SCHEMA = "doc_id long, text string, source string, n_chars long"


def test_one_row_of_each_component_stays(spark):
    rows = [(7, LONG), (7, LONG), (7, LONG), (9, LONG), (None, LONG), (None, OTHER), (None, OTHER), (3, "one"), (3, THIRD), (4, ""), (4, None), (5, ""), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    out = Counter((r.doc_id, r.text or "") for r in kept.collect())
    assert out == Counter([(7, LONG), (None, OTHER), (3, "one"), (3, THIRD), (4, ""), (5, ""), (None, "")])
    # the next stage leaves the one that stays whole
    clean = corpus_pipeline.repeated_passages(spark, kept, "").collect()
    assert {r.text for r in clean} >= {LONG, OTHER, THIRD}
    assert kept.columns == docs.columns
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), "").count() == 0


def test_mix_repeats_rows_of_one_id_no_more_than_it_takes(spark):
    rows = [(1, f"x{i} y", "s1", i) for i in range(30)] + [(None, f"z{i} y", "s2", i) for i in range(30)] + [(2, "same row", "s3", 0)] * 10
    docs = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.mixed_sources(spark, docs, "")
    taken = Counter(tuple(r) for r in out.collect())
    assert set(taken) <= set(rows)
    times = Counter(rows)
    assert all(n <= 2 * times[r] for r, n in taken.items())
    by_source = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    found = Counter()
    for r, n in taken.items():
        found[r[2]] += n
    assert found == by_source
