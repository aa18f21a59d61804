"""Whitening against numpy's eigenvectors and whole-number arithmetic."""

import numpy as np
import pytest

from crosspanel.llm import whitening


def matrices(d: int):
    r = np.random.default_rng(d)
    a = r.standard_normal((d, d))
    q, _ = np.linalg.qr(a)
    repeated = (q * np.round(np.sort(r.random(d) * 3))) @ q.T
    return [a @ a.T, np.eye(d) * 3, (repeated + repeated.T) / 2, np.diag(r.random(d)), np.zeros((d, d)), 1e200 * (a @ a.T)]


@pytest.mark.parametrize("d", [1, 2, 3, 5, 64, 150])
def test_leading_eigenvectors(d):
    for a in matrices(d):
        values, vectors = whitening.leading(a, 8)
        expected = np.sort(np.linalg.eigvalsh(a))[::-1][:8]
        size = max(np.abs(expected).max(), 1e-300)
        assert np.abs(values - expected).max() <= 1e-12 * size
        assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() <= 1e-12
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * size


def test_equals_numpy(spark):
    r = np.random.default_rng(3)
    v = r.standard_normal((301, 12)) * np.linspace(0.1, 1, 12)
    rows = [(i % 250, [float(c) for c in x]) for i, x in enumerate(v)] + [(None, [float(c) for c in v[0]]), (900, None), (901, [None] * 12), (902, [float("inf")] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' dim", "1 v", "2 n", "3 component")
    out = whitening.whiten(df.repartition(7)).toPandas()
    x = np.floor(1024 * np.vstack([v, v[:1]])).astype(int) + 100_000
    n, s = len(x), x.sum(0)
    w, u = np.linalg.eigh(np.cov(x.T, bias=True))
    white = np.abs((x - s / n) @ u[:, ::-1][:, :8] / np.sqrt(w[::-1][:8]))
    ids = [a for a, b in rows[:302]]
    dev = ((n * x - s) ** 2).sum(1)
    expected = sorted((-1 if i is None else i, c + 1, n, int(d), p, w[::-1][c] / w.sum()) for i, d, row in zip(ids, dev, white, strict=True) for c, p in enumerate(row))
    found = sorted((-1 if r.vec_id != r.vec_id else int(r.vec_id), r.component, r.n, int(r.deviation), abs(r.whitened), r.explained) for r in out.itertuples())
    assert [e[:4] for e in expected] == [f[:4] for f in found]
    assert np.allclose([e[4:] for e in expected], [f[4:] for f in found], rtol=0, atol=1e-9)
    assert out.identity_error.max() < 1e-9 and out.identity_error.nunique() == 1
    again = whitening.whiten(df.repartition(3)).toPandas()
    order = ["vec_id", "component", "whitened"]
    assert np.allclose(out.sort_values(order).whitened, again.sort_values(order).whitened, rtol=0, atol=1e-12)  # the same model, up to the products of batches


def test_edges(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    lone = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, [5.0])], kind)).collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in lone] == [(i, 1, 0, None, 0.0, None) for i in (1, 1, 3)]
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0, -float(i)]) for i in range(4)], kind)).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1} and len(flat) == 12
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 4.0])], kind)).collect()
    assert [r.deviation is None for r in sorted(huge)] == [True] * 4 + [False] * 2


def test_turns_give_the_same_rows(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, [float(c) for c in r.standard_normal(2 + i % 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    once = sorted(map(tuple, whitening.whiten(df).collect()))
    monkeypatch.setattr(whitening, "MATRIX_BYTES", 1)
    assert sorted(map(tuple, whitening.whiten(df).collect())) == once
