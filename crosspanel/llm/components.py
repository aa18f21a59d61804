"""Connected components of an edge table by alternating large-star and small-star steps.

Each step hangs the neighbours of a node on the smallest one. Steps are joins with partial aggregates, so a node with very
many neighbours is combined before the shuffle and split by adaptive execution after it; the edges never visit the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Steps

Hint = Callable[[DataFrame], DataFrame]


def _large_star(edges: DataFrame, hint: Hint) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(hint(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame, hint: Hint) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(hint(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none."""
    nodes = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return nodes.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of comparable ids -> (node, root): the smallest node of each node's component, roots left out.

    The number of rounds grows with the logarithm of a component's size: they end when all components are stars. The last
    round's table stays in the shared folder, the others are deleted.
    """
    steps = Steps(edges.sparkSession)
    now = steps.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # two nodes an edge at most, two values of 16 bytes each; a round makes no further edges
    hint = F.broadcast if now.count() * 64 <= BROADCAST_BYTES else lambda rows: rows
    while not _stars(now):
        before, now = now, steps.keep(_small_star(_large_star(now, hint), hint))
        steps.drop(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
