"""Exact quantiles, sequence stores, mergeable moments, user functions, plans that read little."""

import datetime
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import callables as cb
from crosspanel.operators import features as ft
from crosspanel.operators import graph as gr
from crosspanel.operators import quantiles as qs
from crosspanel.operators import timeseries as ts

DAY = datetime.date(2020, 1, 1)


def interpolated(values, share):
    v = sorted(values)
    at = share * (len(v) - 1)
    low = math.floor(at)
    return v[low] if at == low else v[low] + (v[low + 1] - v[low]) * (at - low)


@pytest.mark.parametrize(("small", "grid"), [(1_000_000, 32), (20, 4), (3, 8)])
def test_exact_quantiles(spark, monkeypatch, small, grid):
    monkeypatch.setattr(qs, "SMALL", small)
    monkeypatch.setattr(qs, "GRID", grid)
    r = random.Random(5)
    groups = {"a": [r.gauss(0, 1e6) for _ in range(700)], "b": [7.0] * 400 + [1.0, 9.0], "c": [5.0], None: [float(r.randrange(9)) for _ in range(300)], "d": [r.choice([1e300, -1e300, 0.0, 1e-300]) for _ in range(101)], "e": [None]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").withColumnRenamed("g", "p").repartition(5)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(x.p, x.share): x.value for x in qs.exact_quantiles(df, "v", ["p"], shares).collect()}
    expected = {(g, s): interpolated(vs, s) for g, vs in groups.items() if vs != [None] for s in shares}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(v, rel=1e-12, abs=1e-300) for k, v in expected.items())
    assert qs.exact_quantiles(df.where("false"), "v", [], [0.5]).count() == 0
    wide = {x.p: (x.n, x.middle) for x in qs.with_quantiles(df.groupBy("p").agg(F.count(F.lit(1)).alias("n")), df, "v", ["p"], {"middle": 0.5}).collect()}
    assert wide["e"] == (1, None) and wide[None][1] == interpolated(groups[None], 0.5)


def series(entities=3, n=47, seed=2):
    r = random.Random(seed)
    return [(i, DAY + datetime.timedelta(days=k), r.gauss(10, 3) if r.random() > 0.1 else None, r.gauss(0, 1)) for i in range(entities) for k in range(n - 15 * i)]


def test_sequence_store_equals_copied_windows(spark):
    df = spark.createDataFrame(series(), "id int, d date, x double, y double")
    copied = {(r.id, r.d): (r.seq, r.mask) for r in ft.sequences(df, ["x", "y"], 8, 5, "seq").collect()}
    store = ft.sequence_store(df, ["x", "y"], 8, block_rows=10)
    found = ft.sliced(ft.sequence_index(df, 8, 5, block_rows=10), store, 2, 8, "seq")
    assert {(r.id, r.d): (r.seq, r.mask) for r in found.collect()} == copied
    kept = store.select(F.sum(F.size("values"))).first()[0]
    assert kept <= 2 * df.count() and max(r.n for r in store.select(F.size("values").alias("n")).collect()) <= 17
    z = {(r.id, r.d): r.y for r in ft.sequence_index(df, 8, 1, "y").collect()}
    for day in {k[1] for k in z}:
        mine = [row[3] for row in series() if row[1] == day]
        sd = np.std(mine, ddof=1) if len(mine) > 1 else None
        for row in series():
            if row[1] == day:
                assert z[row[0], day] is None if not sd else abs(z[row[0], day] - (row[3] - np.mean(mine)) / sd) < 1e-9


def test_tail_from_moments_equals_the_full_run(spark):
    df = spark.createDataFrame(series(4, 60), "id int, d date, x double, y double").where("d is not null").withColumn("x", F.col("x") + 1e6)
    cut = [DAY + datetime.timedelta(days=k) for k in (10, 25)]
    a, b, tail = df.where(F.col("d") < cut[0]), df.where((F.col("d") >= cut[0]) & (F.col("d") < cut[1])), df.where(F.col("d") >= cut[1])
    history = ts.merge_moments(ts.moments(a, "x"), ts.moments(b.where("id <> 1"), "x"))
    history = ts.merge_moments(history, ts.moments(b.where("id = 1"), "x"))
    full = {(r.id, r.d): r.z for r in ts.expanding_z(df, "x", "z", 7).where(F.col("d") >= cut[1]).collect()}
    found = {(r.id, r.d): r.z for r in ts.expanding_z_tail(tail, history, "x", "z", 7).collect()}
    assert found.keys() == full.keys()
    assert all((v is None) == (found[k] is None) and (v is None or abs(v - found[k]) < 1e-6) for k, v in full.items())
    new = ts.expanding_z_tail(tail, history.where("false"), "x", "z", 3)  # entities without a history
    assert {(r.id, r.d): None if r.z is None else round(r.z, 6) for r in new.collect()} == {(r.id, r.d): None if r.z is None else round(r.z, 6) for r in ts.expanding_z(tail, "x", "z", 3).collect()}


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_blocks_change_nothing_for_functions_that_look_back(spark, block):
    df = spark.createDataFrame(series(), "id int, d date, x double, y double")

    def means(table: pa.Table) -> pa.Table:
        y = table.column("y").to_numpy()
        return table.select(["id", "d"]).append_column("m", pa.array([float(np.mean(y[max(0, i - 3) : i + 1])) for i in range(len(y))]))

    expected = {(r.id, r.d): r.m for r in df.withColumn("m", F.avg("y").over(ts.PANEL.series(4))).collect()}
    got = cb.transform_groups(df, ["id"], ["d"], means, "id int, d date, m double", context=3, block_rows=block).collect()
    assert len(got) == len(expected) and all(abs(r.m - expected[r.id, r.d]) < 1e-12 for r in got)

    def peaks(table: pa.Table) -> pa.Table:
        y = table.column("y").to_numpy()
        return table.select(["id", "d"]).take(pa.array(np.array([i for i in range(3, len(y)) if y[i] == max(y[i - 3 : i + 1])], np.int64)))

    found = sorted((r.id, r.d) for r in cb.detect(df, "id", "d", {"peak": peaks}, "id int, d date", 3, block).collect())
    by = {}
    for i, d, _, y in series():
        by.setdefault(i, []).append((d, y))
    assert found == sorted((i, v[k][0]) for i, v in by.items() for k in range(3, len(v)) if v[k][1] == max(x[1] for x in v[k - 3 : k + 1]))


def test_memberships_grow_with_members(spark):
    members = spark.createDataFrame([(i, "big") for i in range(200)] + [(i, "odd") for i in range(1, 200, 2)] + [(3, "lone"), (None, "big"), (5, None), (999, "big"), (3, "big")], "id int, grp string")
    universe = spark.range(200).select(F.col("id").cast("int").alias("id"))
    edges = gr.membership_edges(members, "grp", universe)
    assert edges.count() == 300
    assert [tuple(r) for r in gr.members_outside(members.where("id is not null and grp is not null"), "grp", universe).collect()] == [(999, "big")]
    near = {r.dst: r.shared for r in gr.group_neighbours(edges, spark.createDataFrame([(7,)], "id int"), 120).collect()}
    assert near == {i: 2 for i in range(1, 200, 2) if i != 7} | {i: 1 for i in range(0, 42, 2)}
