"""Exact quantiles of groups of any size, by passes that narrow down the bucket in which a rank lies.

``median`` and ``percentile`` hold every distinct value of a group in one buffer. Here a group's values are cut into ``GRID`` buckets at
approximate quantiles (bounded sketches, combined before the shuffle); exact counts of the buckets tell which one holds each wanted
rank, and only its values go on, equal ones as one with a count. A bucket of one value is its own answer. When every wanted bucket has
``SMALL`` different values at most, those alone are sorted. The approximation decides how fast buckets shrink, never the result.

Defined results: nulls have no rank; a group without values has no row; null is a group of its own; values are interpolated between
ranks as by ``percentile`` (``quantile_cont``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written

GRID, SMALL = 32, 1_000_000


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy("g", "p", "x", *keys).agg(F.sum("c").alias("c"))


def exact_quantiles(df: DataFrame, value: Column | str, by: list[str], shares: list[float]) -> DataFrame:
    """by, share, value: the quantiles of each group."""
    value = F.col(value) if isinstance(value, str) else value
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_all"))
    rows = df.select(group.alias("g"), F.lit(0).cast("decimal(38,0)").alias("p"), value.cast("double").alias("x"), F.lit(1).cast("long").alias("c")).where("x is not null")
    sizes = written(rows.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n")))
    at = lambda share: F.lit(float(share)) * (F.col("n") - 1)
    each = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), w.cast("long").alias("k")) for s in shares for w in (F.floor(at(s)), F.ceil(at(s)))]))
    wanted = written(sizes.select("g", "p", "n", each.alias("w")).select("g", "p", "w.share", "w.k", F.col("w.k").alias("rank")).distinct())
    largest = sizes.agg(F.max("n")).first()[0] or 0
    done: list[DataFrame] = []
    while largest > SMALL:
        points = F.array(*[F.lit(i / GRID) for i in range(1, GRID)])
        edges = written(rows.groupBy("g", "p").agg(F.percentile_approx("x", points, 100 * GRID).alias("e")))
        binned = rows.join(edges, ["g", "p"]).withColumn("b", F.size(F.filter("e", lambda v: v < F.col("x")))).drop("e")
        buckets = binned.groupBy("g", "p", "b").agg(F.sum("c").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("rows"))
        so_far = Window.partitionBy("g", "p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # GRID rows at most
        buckets = written(buckets.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))))
        picked = written(wanted.join(buckets, ["g", "p"]).where("k >= before and k < before + n"))
        done.append(picked.where("low = high").select("g", "share", "rank", F.col("low").alias("x")))
        picked = picked.where("low < high")
        further = (F.col("p") * GRID + F.col("b")).cast("decimal(38,0)").alias("p")
        rows = written(_counted(binned.join(picked.select("g", "p", "b").distinct(), ["g", "p", "b"]).select("g", further, "x", "c")))
        wanted = written(picked.select("g", further, "share", (F.col("k") - F.col("before")).alias("k"), "rank"))
        left = rows.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        largest = left if left < largest else 0  # a bucket that no edge cuts is sorted as it is
    few = _counted(rows)
    placed = few.withColumn("end", F.sum("c").over(Window.partitionBy("g", "p").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    done.append(wanted.join(placed, ["g", "p"]).where("k < end and k >= end - c").select("g", "share", "rank", "x"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    ends = found.groupBy("g", "share").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("rank").alias("r"))
    ends = ends.join(sizes.select("g", "n"), "g").withColumn("f", F.col("share") * (F.col("n") - 1) - F.col("r"))
    return ends.select(*[F.col(f"g.{c}") for c in by], "share", F.when(F.col("f") > 0, F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).otherwise(F.col("a")).alias("value"))


def with_quantiles(groups: DataFrame, df: DataFrame, value: Column | str, by: list[str], named: dict[str, float]) -> DataFrame:
    """One row a group, with its quantiles under these names; null for a group without values."""
    found = exact_quantiles(df, value, by, sorted(set(named.values())))
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(name) for name, s in named.items()])
    if not by:
        return groups.crossJoin(wide)  # one row each
    wide = wide.select(*[F.col(c).alias(f"_by_{c}") for c in by], *named)
    same = None
    for c in by:
        one = F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        same = one if same is None else same & one
    return groups.join(wide, same, "left").drop(*[f"_by_{c}" for c in by])
