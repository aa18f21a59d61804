"""Best partners by cells of blocks against all pairs, with ties, gaps, odd values and constant series; no pair is a row."""

import numpy as np
import pytest

from crosspanel.operators import graph as gr
from crosspanel.operators import pairs
from crosspanel.operators import timeseries as ts
from crosspanel.plans import catalog
from crosspanel.sources import files
from crosspanel.sources import fixtures as fx


def brute(rows, dates, threshold, top, least, digits):
    known = [d for d in sorted({d for _, d, x in rows if x is not None}, reverse=True)][:dates]
    series = {}
    for i, d, x in rows:
        if x is not None and d in known:
            series.setdefault(i, {})[d] = x
    out = set()
    for i, a in series.items():
        found = []
        for j, b in series.items():
            common = sorted(a.keys() & b.keys())
            if i != j and len(common) >= least:
                x, y = np.array([a[d] for d in common]), np.array([b[d] for d in common])
                if np.isfinite(x).all() and np.isfinite(y).all() and np.ptp(x) and np.ptp(y):
                    found.append((-round(float(np.corrcoef(x, y)[0, 1]), digits), j))
        out |= {(i, j, -w) for w, j in sorted(x for x in found if -x[0] > threshold)[:top]}
    return out


@pytest.mark.parametrize(("block", "threshold"), [(2048, 0.15), (16, 0.15), (16, -0.2)])
def test_correlations_equal_all_pairs(spark, monkeypatch, block, threshold):
    monkeypatch.setattr(pairs, "ROWS", 7)
    monkeypatch.setattr(pairs, "COLUMNS", 11)
    monkeypatch.setattr(pairs, "block_count", lambda n, row_bytes, size: -(-n // size))
    r = np.random.default_rng(5)
    common = r.normal(size=30)
    rows = []
    for i in range(60):
        x = r.normal(size=30) + common * (i % 3)
        x = {50: np.full(30, 0.3), 51: 1e6 + x, 52: 1e-9 * x}.get(i, x)
        if i >= 55:  # copies: their weights tie
            x = np.array([row[2] for row in rows[30 * (i - 50) : 30 * (i - 49)]], dtype=float)
        rows += [(i, d, None if i < 50 and r.random() < 0.2 else float(v)) for d, v in enumerate(x)]
    rows[5] = (0, 5, float("nan"))
    df = spark.createDataFrame(rows, "id long, k int, x double").selectExpr("id", "date_add(date'2024-01-01', k) d", "x")
    edges = {(e.src, e.dst, e.weight) for e in gr.rolling_correlation_edges(df, "x", 20, threshold, 4, 8, block).collect()}
    assert edges == brute(rows, 20, threshold, 4, 8, 7)
    assert {(e.src, e.dst, e.weight) for e in gr.correlation_edges(df, "x", threshold, 4, 8, block).collect()} == brute(rows, 99, threshold, 4, 8, 9)


def test_pairs_of_series_are_not_joined(spark):
    df = spark.range(40).selectExpr("id % 8 id", "date_add(date'2024-01-01', cast(id / 8 as int)) d", "rand(1) x")
    plan = gr.correlation_edges(df, "x", 0.15, 5, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_panel_is_dealt_once(spark):
    plan = ts.pct_change(fx.panel(spark, "/root/testdata/sf0.001"), "close", 1, "ret")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["m04_lasso_scores", "o04_fold_scores"])
def test_folds_and_passes_read_what_was_written_once(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_written_rows_leave_no_setting_behind(spark):
    assert sorted(x.id for x in files.written(spark.range(5).repartition(3, "id")).collect()) == [0, 1, 2, 3, 4]
    assert spark.conf.get(files.CLEAN) == "false"


@pytest.mark.parametrize("joined", [20, -1])
@pytest.mark.parametrize("block", [2048, 16])
def test_shared_groups_equal_a_join(spark, monkeypatch, joined, block):
    monkeypatch.setattr(gr, "JOINED", joined)
    monkeypatch.setattr(pairs, "ROWS", 7)
    monkeypatch.setattr(pairs, "COLUMNS", 9)
    monkeypatch.setattr(pairs, "block_count", lambda n, row_bytes, size: -(-n // size))
    r = np.random.default_rng(6)
    rows = sorted({(f"m{i:02d}", f"g{g}") for i in range(50) for g in r.integers(0, 12, 4 if i % 5 else 1).tolist()} | {("x", "alone")})
    edges = spark.createDataFrame(rows, "src string, dst string")
    asked = sorted({a for a, _ in rows if a != "m03"})
    of = {a: {g for b, g in rows if b == a} for a in {a for a, _ in rows}}
    want = {(a, b, n) for a in asked for n, b in [(-m, b) for m, b in sorted((-len(of[a] & of[b]), b) for b in of if b != a and of[a] & of[b])[:6]]}
    got = gr.group_neighbours(edges, spark.createDataFrame([(a,) for a in asked], "id string"), 6, block)
    assert got.columns == ["src", "dst", "shared"]
    assert {(e.src, e.dst, e.shared) for e in got.collect()} == want
