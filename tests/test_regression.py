"""Sums of products, ridge, lasso and boosted trees against numpy and an independent solver."""

import time

import numpy as np
import pytest

from crosspanel.operators import regression as rg


def proximal(x, y, alpha, rounds=60_000):
    """The lasso on standardised features by proximal gradient steps."""
    z = (x - x.mean(0)) / x.std(0)
    c, b = z.T @ z / len(z), z.T @ (y - y.mean()) / len(z)
    step, w = 1 / np.linalg.eigvalsh(c)[-1], np.zeros(x.shape[1])
    for _ in range(rounds):
        w = w - step * (c @ w - b)
        w = np.sign(w) * np.maximum(np.abs(w) - step * alpha, 0)
    return w / x.std(0)


def panel(spark, n=600, p=8, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, p)) @ (np.eye(p) + 0.3 * r.normal(size=(p, p)))
    y = x[:, 0] * 0.6 - x[:, 2] * 0.4 + r.normal(size=n)
    names = [f"x{k}" for k in range(p)]
    rows = [(i % 20, i // 20, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, d int, " + ", ".join(f"{c} double" for c in [*names, "y"])), names, x, y


def test_gram_equals_numpy(spark):
    df, names, x, y = panel(spark)
    df = df.selectExpr("*", "nullif(d % 3, 1) g", "cast(id % 2 as string) h")
    extra = spark.createDataFrame([(1, 1, *[None] * 9, None, None)], df.schema)
    cells = rg.gram(df.unionByName(extra).repartition(9), names, "y", ["g", "h"]).collect()
    z = np.column_stack([np.ones(len(x)), x, y])
    keys = [((i // 20) % 3 if (i // 20) % 3 != 1 else None, str(i % 20 % 2)) for i in range(len(x))]
    place = {c: k for k, c in enumerate(["1", *names, "y"])}
    assert len(cells) == len(set(keys)) * 55
    for key in set(keys):
        mine = z[[k == key for k in keys]]
        g = mine.T @ mine
        got = {(c.i, c.j): c.value for c in cells if (c.g, c.h) == key}
        assert len(got) == 55 and all(place[i] <= place[j] and abs(v - g[place[i], place[j]]) < 1e-9 * max(1, abs(v)) for (i, j), v in got.items())
    vector = df.selectExpr("id", "d", "y", "array(" + ", ".join(names) + ") v")
    odd = spark.createDataFrame([(1, 1, 1.0, [1.0]), (1, 1, None, [1.0] * 8), (1, 1, 1.0, None)], "id long, d int, y double, v array<double>")
    as_array = {(c.i, c.j): c.value for c in rg.gram(vector.unionByName(odd), names, "y", [], "v").collect()}
    as_columns = {(c.i, c.j): c.value for c in rg.gram(df, names, "y", []).collect()}
    assert as_array.keys() == as_columns.keys() and all(abs(as_array[k] - v) < 1e-9 * max(1, abs(v)) for k, v in as_columns.items())
    assert rg.gram(df.where("false"), names, "y", ["g"]).count() == 0


def test_hundreds_of_features_take_seconds(spark):
    r = np.random.default_rng(0)
    df = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(r.normal(size=(1000, 300)), r.normal(size=1000), strict=True)], "y double, v array<double>")
    began = time.time()
    assert rg.gram(df, [f"f{k}" for k in range(300)], "y", [], "v").count() == 302 * 303 // 2
    assert time.time() - began < 30


def test_lasso_path_equals_another_solver(spark):
    df, names, x, y = panel(spark)
    cells = [(c.i, c.j, c.value) for c in rg.gram(df, names, "y", []).collect()]
    for alpha, weights, intercept in rg.lasso_path(cells, names, "y", [0.5, 0.1, 0.01, 0.3]):
        w = proximal(x, y, alpha)
        assert np.allclose([weights[c] for c in names], w, atol=1e-7)
        assert [weights[c] != 0 for c in names] == [abs(v) > 1e-9 for v in w]
        assert abs(intercept - (y.mean() - x.mean(0) @ w)) < 1e-6
    beta, c = rg.ridge(cells, names, "y", 10.0)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(8), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose([beta[n] for n in names], w) and abs(c - (y.mean() - x.mean(0) @ w)) < 1e-9


def test_constant_and_equal_features(spark):
    df = spark.createDataFrame([(float(i % 7), 3.0, float(i % 7), float(i % 7) + (i % 3)) for i in range(60)], "a double, b double, c double, y double")
    cells = [(c.i, c.j, c.value) for c in rg.gram(df, ["a", "b", "c"], "y", []).collect()]
    (_, weights, _), = rg.lasso_path(cells, ["a", "b", "c"], "y", [0.05])
    assert weights["b"] == 0 and abs(weights["a"] + weights["c"] - 1) < 0.1


@pytest.mark.parametrize(("ics", "best"), [([(1.0, 0.1), (0.1, 0.3), (0.01, 0.2), (0.001, 0.1), (0.0001, 0.9)], 0.1), ([(1.0, None), (0.1, None)], 1.0), ([(1.0, 0.1), (0.5, 0.05), (0.1, 0.4)], 0.1)])
def test_early_stop(ics, best):
    assert rg.early_stop(ics, 2) == best


def test_lasso_chooses_by_validation(spark):
    df, names, x, y = panel(spark)
    weights, intercept, report = rg.lasso(df.where("d < 20"), df.where("d >= 20"), names, "y", [1.0, 0.3, 0.1, 0.03], 10)
    chosen = [r for r in report.collect() if r.chosen]
    assert len(chosen) == 1 and chosen[0].alpha < 1.0
    assert np.allclose([weights[c] for c in names], proximal(x, y, chosen[0].alpha), atol=1e-7)


def test_boosted_trees_learn_a_step(spark):
    r = np.random.default_rng(4)
    rows = [(i, float(a), None if i % 9 == 0 else float(b), (2.0 if a > 0 else -1.0) if i % 11 else None) for i, (a, b) in enumerate(r.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    out = rg.boosted_trees(df, ["a", "b"], "y", df["id"] % 5 == 0, "pred", rounds=10, depth=2).toPandas()
    assert len(out) == 600 and np.mean(np.abs(out.pred - np.where(out.a > 0, 2.0, -1.0)) < 0.2) > 0.95
