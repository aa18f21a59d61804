"""Tables that streams write batch by batch, and that a restart finds as they were.

A table of keyed, dated rows is a folder of data by batch and date, and a ledger of the dates that each batch has written. A batch
reads the present rows of its own dates alone, merges them with its rows, writes these dates again under its own number, and then its
line of the ledger: that line is the commit. What a broken batch left behind has no line, and is overwritten when the batch runs again.
So bytes written grow with the dates of a batch, not with the table. Nothing is kept on the driver between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.pit import upsert


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """batch, day: what the committed batches have written; None before the first."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema("day date, batch long").parquet(f"{path}/ledger")


def current(spark: SparkSession, path: str, schema: StructType, date: str, before: int | None = None, days: list | None = None) -> DataFrame:
    """The table as the last committed batch left it, or as it was before a batch; of all dates or of some.

    Only the folders of current batches are listed and read; their names, one a date, are what the driver holds.
    """
    ledger = _ledger(spark, path)
    if ledger is None:
        return spark.createDataFrame([], schema)
    if before is not None:
        ledger = ledger.where(F.col("batch") < before)
    newest = ledger.groupBy("day").agg(F.max("batch").alias("batch"))
    folders = [f"{path}/data/batch={r.batch}/day={r.day}" for r in newest.toLocalIterator() if days is None or r.day in days]
    if not folders:
        return spark.createDataFrame([], schema)
    kind = StructType([f for f in schema.fields if f.name != date]).add("batch", "long").add("day", "date")
    return spark.read.schema(kind).option("basePath", f"{path}/data").parquet(*folders).withColumnRenamed("day", date).select(*schema.names)


def merge_batch(rows: DataFrame, batch: int, path: str, keys: list[str], date: str, sequence: str, allow_shrink: bool = False) -> None:
    """Merges one batch into the table. Of rows with one key the one with the largest sequence stays, old or new; rows without a date go.

    With ``allow_shrink`` the batch alone says what its dates hold.
    """
    spark, schema = rows.sparkSession, rows.schema
    rows = rows.where(F.col(date).isNotNull())
    days = rows.select(date).distinct()
    last = lambda df: df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in schema.names if c not in keys]), sequence).alias("_v")).select(*keys, "_v.*").select(*schema.names)
    old = current(spark, path, schema, date, batch, [r[0] for r in days.collect()])  # the dates of one batch
    new = last(rows)
    if allow_shrink:
        merged = upsert(old, new, keys, allow_shrink=True)
    else:
        merged = last(old.unionByName(new))
    out = merged.withColumnRenamed(date, "day").repartition("day")
    out.write.mode("overwrite").partitionBy("day").parquet(f"{path}/data/batch={batch}")
    days.select(F.col(date).alias("day")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch={batch}")


def upsert_stream(stream: DataFrame, path: str, keys: list[str], date: str, sequence: str, allow_shrink: bool = False) -> None:
    """Runs a stream to the end of its input into the table at ``path``; called again, it goes on where it stopped."""
    query = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    query.foreachBatch(lambda rows, batch: merge_batch(rows, batch, path, keys, date, sequence, allow_shrink)).start().awaitTermination()


def compact(spark: SparkSession, path: str, schema: StructType, date: str, target: str) -> None:
    """Writes the present rows as batch 0 of a table at another path, without what later batches have replaced.

    The stream's state stays with the old path: further batches need a stream of their own.
    """
    now = current(spark, path, schema, date).withColumnRenamed(date, "day")
    now.repartition("day").write.partitionBy("day").parquet(f"{target}/data/batch=0")
    now.select("day").distinct().coalesce(1).write.parquet(f"{target}/ledger/batch=0")
