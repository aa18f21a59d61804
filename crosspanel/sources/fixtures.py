"""Panels derived from the order tables, in the shapes that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """id, d, open, high, low, close, volume of each supplier and week (or day).

    The lines are dealt by id once, which is what windows by id ask for as well. Sums made before that would not be smaller: few lines of
    a task have an id and a week in common, and each would carry two orders.
    """
    price = F.expr("l_extendedprice / l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    rows = lines.repartition("id").groupBy("id", F.date_trunc(unit, "l_shipdate").cast("date").alias("d"))
    return rows.agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum("l_quantity").alias("volume"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, period_end, type, value: quarterly statements in long form."""
    quarter = F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate"), 2))
    wide = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id"), quarter.alias("period_end")).agg(
        F.expr("sum(l_extendedprice * (1 - l_discount))").alias("rev"), F.sum("l_quantity").alias("qty"), F.expr("sum(l_extendedprice * l_tax)").alias("tax")
    )
    return wide.unpivot(["id", "period_end"], ["rev", "qty", "tax"], "type", "value")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, category, size_v of each supplier."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    joined = read(spark, sf_dir, "supplier").join(F.broadcast(nation), F.expr("s_nationkey = n_nationkey"))
    joined = joined.join(F.broadcast(region), F.expr("n_regionkey = r_regionkey"))
    return joined.select(F.col("s_suppkey").alias("id"), F.col("r_name").alias("category"), F.col("s_acctbal").alias("size_v"))


def adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, d, adj_factor: adjustment events."""
    rows = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_discount >= 0.08")
    return rows.groupBy(F.col("l_suppkey").alias("id"), F.date_trunc("week", "l_shipdate").cast("date").alias("d")).agg(F.min(F.expr("1 - l_discount")).alias("adj_factor"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, status, start_d, end_d: intervals in which a status holds."""
    rows = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.date_trunc("week", "ts"))
    return rows.agg(F.min(F.to_date("ts")).alias("start_d"), F.max(F.to_date("ts")).alias("end_d")).select("id", "status", "start_d", "end_d")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, d, close, volume, score (reversal), unc (rolling volatility), label (forward return)."""
    from ..operators import timeseries as ts

    p = ts.pct_change(panel(spark, sf_dir), "close", 1, "ret")
    p = ts.rolling(p, "ret", "stddev_samp", 20, 10, "unc")
    p = ts.pct_change(ts.forward_return(p, "close", 5, "label"), "close", 5, "mom")
    out = p.select("id", "d", "close", "volume", F.round(-F.col("mom"), 9).alias("score"), F.round("unc", 9).alias("unc"), F.round("label", 9).alias("label"))
    return out.where("score is not null")
