"""Helpers shared by the training-data operators: the word pattern, shared storage, batches and broadcasting rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name that none of the columns has, in any case of its letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    In local mode, where both are one process, a temporary folder serves if it is unset; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="crosspanel-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession) -> str:
    """A path of its own in this application's part of the shared folder."""
    return f"{shared_folder(spark)}/crosspanel-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Deletes every table that this application's operators have left in the shared folder; their results go with them."""
    delete(spark, f"{shared_folder(spark)}/crosspanel-{spark.sparkContext.applicationId}")


class Steps:
    """Tables written between the steps of one operator. Those that its result does not read are deleted at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for p, t in self.paths.items() if any(t is x for x in tables)]:
            del self.paths[path]
            delete(self.spark, path)

    def end(self, *still_read: DataFrame) -> None:
        self.drop(*[t for t in self.paths.values() if not any(t is x for x in still_read)])


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder as Parquet and reads them back.

    A lost executor costs nothing afterwards, since the files do not live with it.
    """
    return Steps(df.sparkSession).keep(df)


#: A table whose rows take at most so many bytes in all is broadcast; beyond that, joins shuffle.
BROADCAST_BYTES = 32 << 20


def few(rows: DataFrame) -> DataFrame:
    """Rows of numbers, marked for broadcast if a count shows that they are few: 16 bytes for each value."""
    return F.broadcast(rows) if rows.count() * 16 * len(rows.columns) <= BROADCAST_BYTES else rows


#: Bytes of text that one step of a Python function holds; a longer text is a step of its own.
STEP_BYTES = 4 << 20


#: What ``small_batches`` sets: bytes of a batch for Python, and rows of a batch that a Parquet reader holds.
LIMITS = {"spark.sql.execution.arrow.maxBytesPerBatch": STEP_BYTES, "spark.sql.parquet.columnarReaderBatchSize": 1024}


def small_batches(spark: SparkSession) -> None:
    """Smaller batches of long texts from here on; limits that the session has set itself stay.

    Spark's own limits, 10000 rows for Python and 4096 for a reader, are tens of megabytes of texts in each task, which the
    executor's heap, its memory outside the heap and each Python worker hold again.
    """
    own = spark.conf.getAll
    for limit, value in LIMITS.items():
        if limit not in own:
            spark.conf.set(limit, value)


def steps(batches: Iterator[pa.RecordBatch], *columns: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts, in the columns given, have about ``STEP_BYTES`` bytes."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for c in columns:
            size += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
        cut = np.cumsum(size) // STEP_BYTES
        starts = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]])) if len(cut) else np.zeros(0, np.int64)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
        del batch
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
