"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source wants a share of the budget in proportion to its weight, but no more than ``max_epochs`` times its own size.
Giving the excess of capped sources to the others by weight, again and again, ends where the target of each source is
``min(max_epochs * size, level * weight)`` for one common level; the level follows from the running sums of the sources
in order of cap over weight, so no loop is needed.

A source's documents are then taken ``floor(target / size)`` times whole, and a seeded random order of its documents is
taken once more up to the remaining fraction. The order is cut by running totals over hash buckets, so that a source
that holds a third of all rows is never sorted in one task.

Defined results: null text has size 0; a null source is a source of its own, last in order; a source of size 0 has
target 0; repeated rows count each; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialize

WEIGHTS = (5.0, 2.0, 1.0)
#: 4096 buckets of a source's documents in seeded order.
BUCKET_HEX = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with part, a number that follows the order, written so that it stays: sorting one part needs no other."""
    return materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def _before(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds the totals of these columns over all rows before each row in this order, over all parts of it."""
    parts = rows.groupBy("part").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    starts = parts.select("part", *[F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"{k}_start") for k in sums])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()}).join(F.broadcast(starts), "part")
    return out.withColumns({k: F.col(k) + F.col(f"{k}_start") for k in sums}).drop(*[f"{k}_start" for k in sums])


def water_fill(sources: DataFrame, share: float, max_epochs: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size), one row each -> with weight and target.

    Places in the order of names and of cap over weight come from sorted parts and the parts' totals, so many sources are
    dealt out like any other rows.
    """
    by_name = F.col("source").asc_nulls_last()
    placed = _before(_in_order(sources.select("source", "source_size"), by_name), [by_name], place=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    capped = placed.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    capped = capped.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = [F.col("ratio").asc(), by_name]
    own = _before(_in_order(capped, *order), order, caps=F.col("cap"), weights=F.col("weight"))
    whole = own.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget = F.lit(float((whole["size"] or 0) * share))
    level = (budget - F.col("caps")) / (F.lit(float(whole["weight"] or 0)) - F.col("weights"))
    # the first source, in order of cap over weight, whose cap is not reached gives the level of all after it
    free = own.where(level * F.col("weight") < F.col("cap")).agg(F.min_by(level, F.struct("ratio", F.col("source").isNull(), "source")).alias("level")).first()
    final = F.lit(free["level"]).cast("double")
    target = F.when(final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("weight")))
    return own.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    share: float = 1.5,
    max_epochs: float = 2.0,
    weights: tuple[float, ...] = WEIGHTS,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken, and the columns to carry."""
    # the text is part of the draw, so that rows of one id, or of none, spread over the buckets
    text = F.coalesce(F.col(text_col), F.lit(""))
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text).cast("binary"))
    sized = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            drawn.alias("u"),
            *carry,
        )
    )
    # a null source gets a key of its own, so that plain equality joins hold it
    key = F.concat(F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(F.col("source"), F.lit("")))
    sized = sized.select("*", key.alias("k"), F.substring("u", 1, BUCKET_HEX).alias("bucket"))
    in_bucket = sized.groupBy("k", "source", "bucket").agg(F.sum("size").alias("n"))
    totals = in_bucket.groupBy("k", "source").agg(F.sum("n").alias("source_size"))
    totals = materialize(totals)
    plan = water_fill(totals.select("source", "source_size"), share, max_epochs, weights).select(
        key.alias("k"), "source_size", "target"
    )
    running = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # sources times 4096 rows at most
    starts = in_bucket.select("k", "bucket", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("start"))
    goals = starts.join(plan, "k")
    within = Window.partitionBy("k", "bucket").orderBy("u", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(goals, ["k", "bucket"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    extra = (F.col("start") + F.col("within") + F.col("size") / 2.0) <= rest
    copies = (whole + F.when(extra, F.lit(1)).otherwise(F.lit(0))).cast("int")
    return rows.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), *carry).withColumn(
        "taken", (F.col("copies") * F.col("size")).cast("long")
    )


def repeat_documents(docs: DataFrame, **mixed) -> DataFrame:
    """The documents, each row as often as their ``mix`` with these arguments takes it.

    Rows go by a key of their own, so ids may repeat or be null, and columns may have any names.
    """
    row, times = fresh(docs.columns, "_row"), fresh(docs.columns, "_times")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    copies = mix(keyed, carry=(row,), **mixed).where("copies > 0").select(row, F.col("copies").alias(times))
    repeated = keyed.join(copies, row).withColumn(row, F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
