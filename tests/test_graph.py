"""Peers by size against the reference's definition, in categories smaller and larger than the window."""

import glob
import os

import duckdb

from crosspanel.operators import graph as gr
from crosspanel.plans import catalog

SF = "/root/testdata/sf0.01"


def reference(members: list[int], leaders: int, near: int) -> set[tuple[int, int]]:
    n, out = len(members), set()
    for pos, i in enumerate(members):
        low = max(0, min(pos - max(near // 2, 1), n - near - 1))
        high = min(n, low + near + 1)
        low = max(0, high - near - 1)
        out |= {(i, j) for j in members[:leaders] + members[low:high] if j != i}
    return out


def test_peers_equal_the_reference_at_the_ends(spark):
    sizes = {c: [(f"c{c}", c * 100 + i, None if i == 3 else float((i * 7) % 11 - 2)) for i in range(c)] for c in (1, 2, 5, 10, 11, 12, 40)}
    nodes = spark.createDataFrame([x for v in sizes.values() for x in v] + [(None, 9999, 1.0)], "category string, id long, size_v double")
    for leaders, near in ((5, 10), (3, 4), (0, 3)):
        edges = [(r.src, r.dst) for r in gr.category_peers(nodes, "category", "size_v", leaders, near, 1.0).collect()]
        assert len(edges) == len(set(edges))
        want = set()
        for v in sizes.values():
            want |= reference([i for _, i, _ in sorted(v, key=lambda x: (-(x[2] or 0.0), x[1]))], leaders, near)
        assert set(edges) == want


def test_peer_queries_equal_sql_on_categories_beyond_the_window(spark):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name in ("k01_category_peers", "k08_induced_peers", "k09_peer_degrees"):
        ours, theirs = catalog.QUERIES[name](spark, SF), c.sql(catalog.ORACLES[name])
        assert ours.columns == theirs.columns
        assert sorted(map(tuple, ours.collect())) == sorted(theirs.fetchall())


def test_correlation_edges_run_beside_the_pairs_both_ways(spark):
    # two series that move together, one that moves against them, one too short
    xs = [0.1, -0.2, 0.3, 0.05, -0.1, 0.2]
    rows = [(i, k, sign * x) for i, sign in ((1, 1.0), (2, 2.0), (3, -1.0)) for k, x in enumerate(xs)] + [(4, 0, 0.1), (4, 1, -0.2)]
    panel = spark.createDataFrame(rows, "id long, k int, ret double").selectExpr("id", "date_add(date'2024-01-01', k) d", "ret")
    assert sorted(map(tuple, gr.correlation_edges(panel, "ret", 0.15, 5, 3).collect())) == [(1, 2, 1.0), (2, 1, 1.0)]
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (None, 1)], "a long, b long")
    assert sorted(map(tuple, gr.both_ways(pairs, "a", "b", 5, 0.5).collect())) == [(1, 2, 0.5), (2, 1, 0.5)]
