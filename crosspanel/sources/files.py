"""Readers and writers of the file layouts that daily jobs leave behind: dated trees, nested JSON, logs and archives."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DATE = r"(\d{4}-\d{2}-\d{2})"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; in local mode any folder will do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="crosspanel-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{uuid.uuid4().hex}"


#: Deletes the shuffles of a query at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back; the shuffles that made them go at once, not when the driver collects garbage."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def _day(path: Column) -> Column:
    """The last date among a path's folder names."""
    return F.element_at(F.regexp_extract_all(path, F.lit(DATE), F.lit(1)), -1).cast("date")


def read_dated_csv(spark: SparkSession, root: str, schema: str, date: str = "d", start: str | None = None, end: str | None = None) -> DataFrame:
    """The CSV files of a tree with one folder a date; the date comes from the folder's name, within the range if given."""
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(root)
    rows = rows.withColumn(date, _day(F.col("_metadata.file_path")))
    if start is not None:
        rows = rows.where(F.col(date) >= F.lit(start).cast("date"))
    return rows if end is None else rows.where(F.col(date) <= F.lit(end).cast("date"))


def read_signal_json(spark: SparkSession, root: str, schema: str, arrays: list[str], date: str = "d") -> DataFrame:
    """One row for each record in the arrays of dated nested JSON files; null arrays count as empty."""
    files = spark.read.schema(schema).option("recursiveFileLookup", True).json(root, multiLine=True)
    empty = lambda c: F.coalesce(c, F.array().cast(files.schema[c].dataType))
    one = files.select(_day(F.col("_metadata.file_path")).alias(date), F.explode(F.concat(*[empty(c) for c in arrays])).alias("_s"))
    return one.select(date, "_s.*")


def read_log(spark: SparkSession, path: str, schema: str, key: str = "d", sequence: str = "seq") -> DataFrame:
    """The last record of each key in a JSON-lines log; records carry a sequence number."""
    w = Window.partitionBy(key).orderBy(F.col(sequence).desc())
    return spark.read.schema(schema).json(path).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def write_archive(df: DataFrame, path: str, date: str = "d", keep: int | None = None) -> None:
    """Writes each date of the rows as a partition, replacing only those, and keeps the latest ``keep`` dates of the archive."""
    spark = df.sparkSession
    df.repartition(date).write.partitionBy(date).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    if keep is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        parts = sorted((p.getPath().toString() for p in fs.listStatus(target) if f"{date}=" in p.getPath().getName()), reverse=True)
        for old in parts[keep:]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)


def merge_staging(production: DataFrame, staging: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Staged rows over production rows, in production's columns: missing ones are null, further ones go.

    Of rows of one key the staged ones win, of those the one with the largest sequence number, then the largest row.
    """
    given = {c.lower(): c for c in staging.columns}
    aligned = staging.select(*[(F.col(given[c.lower()]) if c.lower() in given else F.lit(None)).cast(production.schema[c].dataType).alias(c) for c in production.columns], F.col(sequence).alias("_seq"))
    rows = aligned.withColumn("_new", F.lit(1)).unionByName(production.withColumn("_new", F.lit(0)).withColumn("_seq", F.lit(None).cast(aligned.schema["_seq"].dataType)))
    values = [F.col(c).desc_nulls_last() for c in production.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(F.col("_new").desc(), F.col("_seq").desc_nulls_last(), *values)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*production.columns)


def update_history(index: DataFrame, day: DataFrame, dates: int, date: str = "d") -> DataFrame:
    """An index of records per date with the day's records in place of any it had, cut to the latest dates."""
    rows = index.join(F.broadcast(day.select(date).distinct()), date, "left_anti").unionByName(day)
    latest = rows.select(date).distinct().orderBy(F.col(date).desc()).limit(dates)
    return rows.join(F.broadcast(latest), date, "left_semi")


def load_tables(spark: SparkSession, paths: dict[str, str], dates: dict[str, str], required: tuple[str, ...] = (), date: str = "d") -> dict[str, DataFrame]:
    """The tables that exist, with their date column under one name and as a date. A missing one is left out, a required one an error."""
    found = {}
    for name, path in paths.items():
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            rows = spark.read.parquet(path)
            own = dates.get(name, date)
            found[name] = rows.withColumnRenamed(own, date).withColumn(date, F.to_date(date)) if own in rows.columns else rows
        elif name in required:
            raise FileNotFoundError(f"{name}: {path}")
    return found


def column_bounds(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """low_<column>, high_<column>, n: from the footers of the files where their statistics tell, by aggregation push-down.

    Spark pushes it for whole numbers, floats and dates in its newer source, which this call alone uses; other types are scanned.
    """
    sources, push = "spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown"
    before = {k: spark.conf.get(k) for k in (sources, push)}
    try:
        spark.conf.set(sources, ",".join(x for x in before[sources].split(",") if x != "parquet"))
        spark.conf.set(push, "true")
        out = spark.read.parquet(path).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))], F.count(F.lit(1)).alias("n"))
        out._jdf.queryExecution().executedPlan()  # planned here, while these settings hold
        return out
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
