"""Entity graphs as edge tables (src, dst, weight, kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written
from ..spec import PANEL, PanelSpec
from .pairs import best_correlations, best_shared


def category_edges(nodes: DataFrame, category: str, size: str, leaders: int, near: int, weight: float, key: str = "id") -> DataFrame:
    """Each node with its category's largest members and its neighbours by size; bounded edges per node.

    The window of neighbours is cut at the ends of the order of sizes; ``category_peers`` shifts it.
    """
    w = Window.partitionBy(category).orderBy(F.col(size).desc(), key)
    ranked = nodes.withColumn("_r", F.row_number().over(w)).select(key, category, "_r")
    half = near // 2
    steps = F.explode(F.array_distinct(F.concat(F.sequence(F.lit(1), F.lit(leaders)), F.sequence(F.greatest(F.col("_r") - half, F.lit(1)), F.col("_r") + half)))).alias("_r")
    wanted = ranked.select(F.col(key).alias("src"), category, steps)
    met = wanted.join(ranked.withColumnRenamed(key, "dst"), [category, "_r"]).where("src <> dst")
    return met.select("src", "dst", F.lit(weight).alias("weight"))


def category_peers(nodes: DataFrame, category: str, size: str, leaders: int, near: int, weight: float, key: str = "id") -> DataFrame:
    """Each node with its category's largest members and its ``near`` neighbours by size, fewer only in smaller categories.

    At the ends of the order of sizes the window of neighbours is shifted, not cut. Missing sizes count as 0.
    """
    w = Window.partitionBy(category).orderBy(F.coalesce(F.col(size), F.lit(0)).desc(), key)
    ranked = nodes.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(category)))
    low = F.greatest(F.lit(1), F.least(F.col("_r") - max(near // 2, 1), F.col("_n") - near))
    high = F.least(F.col("_n"), low + near)
    first = [F.lit(k).cast("long") for k in range(1, leaders + 1)]
    steps = F.explode(F.array_distinct(F.concat(F.array(*first).cast("array<long>"), F.sequence(low, high)))).alias("_r")
    wanted = ranked.select(F.col(key).alias("src"), category, steps)
    met = wanted.join(ranked.select(F.col(key).alias("dst"), category, "_r"), [category, "_r"]).where("src <> dst")
    return met.select("src", "dst", F.lit(weight).alias("weight"))


def correlation_edges(returns: DataFrame, col: str, threshold: float, top: int, least: int, block: int = 2048, spec: PanelSpec = PANEL) -> DataFrame:
    """Pairs of entities whose series correlate above the threshold on ``least`` common dates or more, the best few per node."""
    return _correlated(_values(returns, col, spec), None, threshold, top, least, 9, block, spec)


def _values(returns: DataFrame, col: str, spec: PanelSpec) -> DataFrame:
    """entity, date, _x: the known values, written, since they are read for their dates and again for the pairs."""
    return written(returns.where(F.col(col).isNotNull()).select(spec.entity, spec.date, F.col(col).cast("double").alias("_x")))


def _correlated(values: DataFrame, last: int | None, threshold: float, top: int, least: int, digits: int, block: int, spec: PanelSpec) -> DataFrame:
    days = values.select(spec.date).distinct()
    if last is not None:
        days = days.orderBy(F.col(spec.date).desc()).limit(last)
    days = written(days.withColumn("_k", F.row_number().over(Window.orderBy(spec.date)) - 1))  # one row a date
    met = values.join(F.broadcast(days), spec.date)
    series = met.groupBy(F.col(spec.entity).alias("id")).agg(F.collect_list(F.struct("_k", F.col("_x").alias("x"))).alias("xs"))
    return cap_edges(best_correlations(series, days.count() or 1, threshold, top, least, digits, block), top)


def reversed_too(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def cap_edges(edges: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")
    return edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def merge_edges(layers: list[DataFrame], top: int) -> DataFrame:
    """The largest weight of each pair over all layers, the best few per node."""
    every = layers[0]
    for more in layers[1:]:
        every = every.unionByName(more)
    return cap_edges(every.groupBy("src", "dst").agg(F.max("weight").alias("weight")), top)


def refresh_layer(edges: DataFrame, layer: DataFrame, kind: str) -> DataFrame:
    """An edge table (src, dst, weight, kind) with the edges of one kind replaced, all others kept."""
    new = layer.select("src", "dst", "weight", F.lit(kind).alias("kind"))
    return edges.where(~F.col("kind").eqNullSafe(F.lit(kind))).select("src", "dst", "weight", "kind").unionByName(new)


def induced(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges with both ends in the node set."""
    ends = nodes.select(F.col(key).alias("src")).distinct()
    return edges.join(ends, "src", "left_semi").join(ends.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst", "weight")


def degrees(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Summary of out-degrees over all nodes, isolated ones included."""
    n = nodes.select(F.col(key).alias("src")).join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "src", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.min("n").alias("low"), F.median("n").alias("median"), F.max("n").alias("high"), F.count_if(F.col("n") == 0).alias("isolated"))


def extracted_links(pages: DataFrame, key: str, text: str, pattern: str, most: int) -> DataFrame:
    """src, dst: what the pattern's first group finds in each page's whole text, in lower case, the first few by name per page."""
    found = pages.select(F.col(key).alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(1)), F.lower))).alias("dst"))
    w = Window.partitionBy("src").orderBy("dst")
    return found.distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def rolling_correlation_edges(returns: DataFrame, col: str, dates: int, threshold: float, top: int, least: int, block: int = 2048, spec: PanelSpec = PANEL) -> DataFrame:
    """``correlation_edges`` over the last ``dates`` dates, with weights of 7 digits."""
    return _correlated(_values(returns, col, spec), dates, threshold, top, least, 7, block, spec)


def membership_edges(members: DataFrame, group: str, universe: DataFrame, weight: float = 1.0, spec: PanelSpec = PANEL) -> DataFrame:
    """src, dst, weight: edges between members and their groups, which are nodes of their own, one row a membership.

    Two members of a group are two steps apart; an edge for each pair of them would grow with the square of the group. Groups with
    fewer than two members in the universe have no edges.
    """
    known = members.select(spec.entity, group).where(F.col(spec.entity).isNotNull() & F.col(group).isNotNull()).distinct().join(universe.select(spec.entity).distinct(), spec.entity, "left_semi")
    sizes = known.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return known.join(sizes, group).select(F.col(spec.entity).alias("src"), F.col(group).alias("dst"), F.lit(float(weight)).alias("weight"))


def members_outside(members: DataFrame, group: str, universe: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Memberships of entities that the universe lacks."""
    return members.select(spec.entity, group).distinct().join(universe.select(spec.entity).distinct(), spec.entity, "left_anti")


#: Pairs that share a group, for each membership: up to so many meet in a join, more in cells.
JOINED = 20


def group_neighbours(edges: DataFrame, asked: DataFrame, k: int, block: int = 2048, spec: PanelSpec = PANEL) -> DataFrame:
    """src, dst, shared: the k members that share most groups with each entity asked for; ties go to the smaller one.

    The pairs of the entities asked for with the members of their groups are counted first. If they are few they meet in a join; else
    they are counted by cells of blocks of entities (``pairs``), where no pair is a row.
    """
    edges = written(edges.select("src", "dst"))
    first = edges.join(asked.select(F.col(spec.entity).alias("src")).distinct(), "src", "left_semi")
    sizes = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("_n")).join(first.groupBy("dst").agg(F.count(F.lit(1)).alias("_m")), "dst")
    if (sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0.0) <= JOINED * edges.count():
        first = first.select(F.col("src").alias("_a"), "dst")
        met = first.join(edges.select(F.col("src").alias("_b"), "dst"), "dst").where("_a <> _b").groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("weight"))
        met = met.select(F.col("_a").alias("src"), F.col("_b").alias("dst"), "weight")
    else:
        of = lambda e: e.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("groups"))
        met = best_shared(of(edges), of(first), k, block)
    return cap_edges(met, k).withColumnRenamed("weight", "shared")


def both_ways(pairs: DataFrame, a: str, b: str, most: int, weight: float) -> DataFrame:
    """src, dst, weight: each pair as two edges, once, without loops; of a node's edges the first ``most`` by the other end."""
    known = pairs.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`")
    each = known.select(F.col(a).alias("src"), F.col(b).alias("dst")).unionByName(known.select(F.col(b).alias("src"), F.col(a).alias("dst"))).distinct()
    return cap_edges(each.withColumn("weight", F.lit(float(weight))), most)


def add_edges(base: DataFrame, new: DataFrame, top: int) -> DataFrame:
    """The base's edges as they are, and of the new ones that it lacks the best few per node."""
    lacking = new.groupBy("src", "dst").agg(F.max("weight").alias("weight")).join(base.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return base.select("src", "dst", "weight").unionByName(cap_edges(lacking, top).select("src", "dst", "weight"))


def subgraph_coverage(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """edges, covered, nodes, share: how many edges lie within a set of nodes, and how many of the nodes have one."""
    kept = edges.join(nodes.select(F.col(node).alias("src")), "src", "left_semi").join(nodes.select(F.col(node).alias("dst")), "dst", "left_semi")
    found = kept.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("covered"))
    total = nodes.agg(F.countDistinct(node).alias("nodes"))
    return found.crossJoin(total).withColumn("share", F.try_divide("covered", "nodes"))  # one row each


def weight_histogram(edges: DataFrame, bins: int, most: float) -> DataFrame:
    """bin, n: edges by weight in equal bins from 0 to ``most``; what lies beyond counts in the last one."""
    return edges.groupBy(F.least(F.lit(bins - 1), F.floor(F.col("weight") / most * bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def compare_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """removed, added, kept, moved (mean change of weight of those kept)."""
    a, b = old.select("src", "dst", F.col("weight").alias("_a")), new.select("src", "dst", F.col("weight").alias("_b"))
    both = a.join(b, ["src", "dst"], "full_outer")
    lost, gained = F.col("_b").isNull(), F.col("_a").isNull()
    return both.agg(F.count_if(lost).alias("removed"), F.count_if(gained).alias("added"), F.count_if(~lost & ~gained).alias("kept"), F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("moved"))
