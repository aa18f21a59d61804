"""Event streams: windows with a watermark, once-per-key, streaks with state, and freshness.

Functions from stream to stream come first. The last ones run a stream to the end of its input (trigger ``availableNow``) and
return what it has written to the shared folder, so a stream and the batch over the same files can be held against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import scratch


def events(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A Parquet file, or the files of a folder, as a stream, oldest files first; local times count as times of the session's zone."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_a_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    rows = reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name one file
    return rows.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in rows.dtypes])


def windowed(stream: DataFrame, time: str, keys: list[str], width: str, slide: str, delay: str) -> DataFrame:
    """keys, start, n: counts in event-time windows. ``appended`` to a table, a window is final once the watermark (the newest time of
    the batches before, less ``delay``) has passed its end; rows of a window that is final are dropped, and state goes with it."""
    rows = stream.withWatermark(time, delay).groupBy(F.window(time, width, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(*keys, F.col("w.start").alias("start"), "n")


def once(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key among those within ``delay`` of each other; a file that is sent again adds nothing."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def freshness(stream: DataFrame, source: str, time: str) -> DataFrame:
    return stream.groupBy(F.col(source).alias("source")).agg(F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))


def streaks(stream: DataFrame, key: str, value: str, time: str, tie: str, delay: str, idle: str = "3650 days") -> DataFrame:
    """key, last value, how many rows in a row have had it, and the time of the last such row, in order of event time.

    A key's rows wait in its state, in order of time and then ``tie`` (a whole number), until the watermark (the newest time less
    ``delay``) has passed them; rows that come later than that are dropped, so the streak never has to be taken back, and is that of
    the batch over the rows in time. A timer wakes a key whose rows are due without new ones. State goes after ``idle`` without rows.
    Rows without a key or time take no part.
    """

    def follow(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, at, times, ties, values = state.get if state.exists else (None, 0, 0, [], [], [])
        waiting = list(zip(times, ties, values, strict=True))
        due = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for f in frames:
                stamps = (f["_time"]).tolist()
                waiting += [w for w in zip(stamps, f["_tie"].tolist(), f["_value"].tolist(), strict=True) if w[0] > due or due <= 0]
        elif not waiting:
            state.remove()
            return
        waiting.sort(key=lambda w: w[:2])
        done = sum(w[0] <= due for w in waiting)
        for stamp, _, v in waiting[:done]:
            n, last, at = n + 1 if n and v == last else 1, v, stamp
        waiting = waiting[done:]
        state.update((last, n, at, *map(list, zip(*waiting, strict=True))) if waiting else (last, n, at, [], [], []))
        state.setTimeoutTimestamp(max(waiting[0][0] // 1000 if waiting else at // 1000 + keep, due // 1000) + 1)
        if done:
            yield pd.DataFrame({key: [keys[0]], "last": [last], "streak": [n], "at": [pd.Timestamp(at, unit="us")]})

    keep = int(pd.Timedelta(idle).total_seconds() * 1000)
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay)
    rows = rows.select(key, time, F.unix_micros(time).alias("_time"), F.col(tie).cast("long").alias("_tie"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("_value"))
    return rows.groupBy(key).applyInPandasWithState(
        follow, f"{key} {kind}, last string, streak long, at timestamp", "last string, streak long, at long, times array<long>, ties array<long>, texts array<string>",
        "update", GroupStateTimeout.EventTimeTimeout,
    )


def _run(stream: DataFrame, mode: str, write) -> str:
    path = scratch(stream.sparkSession)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    query.foreachBatch(lambda rows, batch: write(rows, batch, path)).start().awaitTermination()
    return path


def appended(stream: DataFrame) -> DataFrame:
    """All rows of an append-only stream. A batch that is run again replaces its own folder."""
    path = _run(stream, "append", lambda rows, batch, path: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}"))
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def complete(stream: DataFrame) -> DataFrame:
    """The last state of a stream of aggregates."""
    path = _run(stream, "complete", lambda rows, batch, path: rows.write.mode("overwrite").parquet(path))
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key of a stream of updates."""
    path = _run(stream, "update", lambda rows, batch, path: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}"))
    rows = stream.sparkSession.read.parquet(path)
    w = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "batch")
