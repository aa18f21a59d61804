"""Embedding whitening: distributed centred covariance, then its leading eigenvectors, then a projection with them.

1. Every entry ``c`` becomes the whole number ``x = floor(1024 c) + 100000``. One pass adds up counts and exact sums.
2. A second pass adds up the products of ``x`` less the whole part of its mean. Such products are whole numbers, so doubles hold
   their sums exactly up to 2**53 in whatever order tasks end, and rows are centred before they are multiplied.
3. The matrix, d by d for vectors of d entries and of the same size whatever the number of rows, is brought to tridiagonal form
   by Householder reflections; its leading eigenvalues come from bisection on Sturm counts, their vectors from inverse iteration,
   which is orthogonalised again among close eigenvalues.
4. Mean and components, ``components`` times d numbers, go to all tasks, which project the rows. A third pass adds up the
   products of the projected rows, so the distance of their covariance from the identity is measured, not assumed.

Partial sums are dealt by row of the matrix and by a salt, so no task adds up those of all others.

Defined results: rows whose vector is null or holds null or non-finite entries take no part; repeated rows and null ids count like
any others; vectors of each length are a fit of their own, in as many turns as their matrices need room; an empty vector and an
empty table give no rows; a component without variance (eigenvalue not above rounding, as for one row alone) has ``whitened``
null and ``explained`` 0, and ``identity_error`` leaves it out (null if there is no other). Entries beyond 2**62 count as that;
``deviation`` is null where it exceeds a long. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from math import copysign, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, MOST = 1024, 100_000, 1 << 62
#: Bytes of the matrices that one turn holds, but for one larger matrix.
MATRIX_BYTES = 128 << 20
EPS = float(np.finfo(float).eps)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """dim, rows and whole numbers of the vectors of each length in each batch (columns dim, v, ...)."""
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            mine = batch.filter(pa.array(dims == dim))
            flat = mine.column(1).flatten().to_numpy(zero_copy_only=False)
            # 2**62 is a double, so the clipped value is a whole number that fits
            yield dim, mine, np.clip(np.floor(flat * SCALE) + SHIFT, -MOST, MOST).astype(np.int64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """dim, v, vec_id of the rows that take part."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v"), F.col(id_col).alias("vec_id")).where(F.forall("v", finite))
    return rows.where(F.size("v") > 0).select(F.size("v").alias("dim"), "v", "vec_id")


def totals(rows: DataFrame) -> DataFrame:
    """dim, at, n, s: number and exact sum of the entries at each place of the vectors of each length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for dim, _, x in _matrices(batches):
            small = max(abs(int(x.max())), abs(int(x.min()))) * len(x) < MOST
            mine = x.sum(0).tolist() if small else [sum(c) for c in x.T.tolist()]
            counts[dim] = counts.get(dim, 0) + len(x)
            sums[dim] = [a + b for a, b in zip(sums.get(dim, [0] * dim), mine, strict=True)]
        for dim, s in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([counts[dim]] * dim, pa.int64()),
                 pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))], ["dim", "at", "n", "s"],
            )

    parts = rows.select("dim", "v").mapInArrow(add, "dim int, at int, n long, s decimal(38,0)")
    return parts.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def product_sums(rows: DataFrame, values: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """The sums of the outer products of the rows of ``values(dim, x)``, for each length."""
    kind = "dim int, i int, salt int, part binary"

    def out(sums: dict[tuple[int, int, int], np.ndarray]) -> pa.RecordBatch:
        keys = list(zip(*sums, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(k, pa.int32()) for k in keys), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["dim", "i", "salt", "part"]
        )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for dim, _, x in _matrices(batches):
            y = values(dim, x)
            sums[dim] = sums[dim] + y.T @ y if dim in sums else y.T @ y
        salt = TaskContext.get().partitionId() % 64
        for dim, g in sums.items():
            yield out({(dim, i, salt): g[i, i:] for i in range(len(g))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for *key, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = np.frombuffer(raw)
                sums[tuple(key)] = sums[tuple(key)] + mine if tuple(key) in sums else mine
        yield out(sums)

    once = rows.select("dim", "v").mapInArrow(multiply, kind).repartition("dim", "i", "salt").mapInArrow(add, kind)
    every = once.withColumn("salt", F.lit(0)).repartition("dim", "i").mapInArrow(add, kind)
    parts: dict[int, dict[int, np.ndarray]] = {}
    for r in every.toLocalIterator():
        parts.setdefault(r.dim, {})[r.i] = np.frombuffer(r.part)
    found = {}
    for dim, mine in parts.items():
        upper = np.zeros((len(mine), len(mine)))
        for i, part in mine.items():
            upper[i, i:] = part
        found[dim] = upper + np.triu(upper, 1).T
    return found


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit vectors of the Householder reflections that bring a symmetric matrix to this form."""
    a, mirrors = matrix.copy(), []
    off = np.zeros(max(0, len(a) - 1))
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = float(np.linalg.norm(v))
        off[k] = -copysign(length, v[0])
        v[0] += copysign(length, v[0])
        if length > 0:
            v /= np.linalg.norm(v)
            p = a[k + 1 :, k + 1 :] @ v
            p -= (v @ p) * v
            a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, p) + np.outer(p, v))
        mirrors.append(v)
    if len(a) > 1:
        off[-1] = a[-1, -2]
    return np.diag(a).copy(), off, mirrors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each point: the negative terms of the Sturm sequence."""
    tiny = np.finfo(float).tiny
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for d, e in zip(diagonal[1:].tolist(), off.tolist(), strict=True):
        q = d - at - e * e / np.where(np.abs(q) < tiny, -tiny, q) if e else d - at
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The largest eigenvalues, falling, by bisection."""
    n = len(diagonal)
    around = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    wide = float(np.abs(diagonal).max() + around.max()) * (1 + 4 * EPS)
    rank = n - 1 - np.arange(min(most, n))  # so many eigenvalues lie below the wanted one
    low, high = np.full(len(rank), -wide), np.full(len(rank), wide)
    for _ in range(200):
        middle = (low + high) / 2
        up = below(diagonal, off, middle) <= rank
        low, high = np.where(up, middle, low), np.where(up, high, middle)
        if np.all(high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))):
            break
    return (low + high) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, value: float, least: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - value I) z = b by elimination with row exchanges; vanishing pivots become ``least``."""
    n = len(diagonal)
    main, one, two = (diagonal - value).tolist(), [*off.tolist(), 0.0], [0.0] * n
    factor, swap = [0.0] * n, [False] * n
    for i in range(n - 1):
        e = float(off[i])
        if abs(e) > abs(main[i]):  # the row below comes first
            swap[i] = True
            factor[i] = main[i] / e
            main[i], one[i], main[i + 1], two[i], one[i + 1] = e, main[i + 1], one[i] - factor[i] * main[i + 1], one[i + 1], -factor[i] * one[i + 1]
        else:
            if abs(main[i]) < least:
                main[i] = least
            factor[i] = e / main[i]
            main[i + 1] -= factor[i] * one[i]
    if abs(main[-1]) < least:
        main[-1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        z = b.tolist()
        for i in range(n - 1):
            if swap[i]:
                z[i], z[i + 1] = z[i + 1], z[i] - factor[i] * z[i + 1]
            else:
                z[i + 1] -= factor[i] * z[i]
        for i in range(n - 1, -1, -1):
            rest = z[i] - (one[i] * z[i + 1] if i + 1 < n else 0) - (two[i] * z[i + 2] if i + 2 < n else 0)
            z[i] = rest / main[i]
        return np.array(z)

    return solve


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration; those of close eigenvalues are kept at right angles."""
    norm = float(np.abs(diagonal).max() + (2 * np.abs(off).max() if len(off) else 0)) or 1.0
    found, draw, first, shifted = [], np.random.default_rng(7), 0, None
    for j, value in enumerate(values.tolist()):
        if j and values[j - 1] - value > 1e-3 * norm:
            first = j
        # equal eigenvalues are told apart by a shift within rounding, so that their iterations differ
        shifted = min(value, shifted - 4 * EPS * norm) if j > first else value
        solve = _solver(diagonal, off, shifted, EPS * norm)
        z = draw.standard_normal(len(diagonal))
        for _ in range(6):
            z = solve(z / np.abs(z).max())
            z /= np.abs(z).max()
            for _ in range(2):
                for other in found[first:]:
                    z -= (other @ z) * other
            z /= np.linalg.norm(z)
        found.append(z)
    return np.array(found).reshape(-1, len(diagonal)).T


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    scale = float(np.abs(matrix).max()) or 1.0
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, most)
    vectors = leading_vectors(diagonal, off, values)
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        vectors[k + 1 :] -= 2 * np.outer(v, v @ vectors[k + 1 :])
    return values * scale, vectors


class Model:
    """What the tasks need for the vectors of one length."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([(s % n) / n for s in sums])  # mean less its whole part

    def fit(self, products: np.ndarray, most: int) -> None:
        covariance = products / self.n - np.outer(self.part, self.part)
        values, vectors = leading(covariance, most)
        trace = float(np.trace(covariance))
        self.live = values > len(values) * len(covariance) * EPS * max(trace, 0.0)
        self.explained = np.where(self.live, values / (trace or 1.0), 0.0)
        self.project = vectors[:, self.live] / np.sqrt(values[self.live])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) - self.part) @ self.project

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)**2, in whole numbers."""
        rest = np.array([s - int(w) * self.n for s, w in zip(self.sums, self.whole, strict=True)], np.int64)  # of the mean, times n
        y = x - self.whole
        if (max(abs(int(y.max())), abs(int(y.min()))) + 1) * self.n <= int(sqrt((1 << 62) / x.shape[1])):
            return ((self.n * y - rest) ** 2).sum(1).tolist()
        found = [sum((self.n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in y.tolist()]
        return [f if f < 1 << 63 else None for f in found]


def _turns(dims: list[int]) -> list[list[int]]:
    """Lengths in turns whose matrices take ``MATRIX_BYTES`` together, or one larger matrix alone."""
    turns: list[list[int]] = []
    room = 0
    for dim in sorted(dims):
        if room < dim * dim * 8:
            turns.append([])
            room = MATRIX_BYTES
        turns[-1].append(dim)
        room -= dim * dim * 8
    return turns


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component.

    For ``apply`` to further vectors, ``fit_models`` gives the models by length.
    """
    rows = usable(vectors, id_col, vector_col)
    out = vectors.sparkSession.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {RESULT}")
    for models, errors in fit_models(rows, components):
        out = out.unionByName(apply(rows, models, errors))
    return out


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def fit_models(rows: DataFrame, components: int) -> Iterator[tuple[dict[int, Model], dict[int, float]]]:
    """Models and identity errors by length, turn by turn (rows: dim, v)."""
    sums: dict[int, list[tuple[int, int, Decimal]]] = {}
    for r in totals(rows).toLocalIterator():
        sums.setdefault(r.dim, []).append((r["at"], r.n, r.s))
    for turn in _turns(list(sums)):
        models = {dim: Model(sums[dim][0][1], [int(s) for _, _, s in sorted(sums[dim])]) for dim in turn}
        mine = rows.where(F.col("dim").between(turn[0], turn[-1]))
        for dim, products in product_sums(mine, lambda dim, x, of=models: of[dim].centred(x)).items():
            models[dim].fit(products, components)
        errors = {}
        with_one = lambda dim, x, of=models: np.column_stack([of[dim].whitened(x), np.ones(len(x))])
        for dim, g in product_sums(mine, with_one).items():
            mean = g[:-1, -1] / models[dim].n
            away = g[:-1, :-1] / models[dim].n - np.outer(mean, mean) - np.eye(len(mean))
            errors[dim] = float(np.abs(away).max()) if len(mean) else None
        yield models, errors


def apply(rows: DataFrame, models: dict[int, Model], errors: dict[int, float]) -> DataFrame:
    """The whitened rows (dim, v, vec_id) of the models' lengths."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, mine, x in _matrices(batches):
            model = models[dim]
            m, k = len(x), len(model.live)
            found = np.full((m, k), np.nan)
            found[:, model.live] = model.whitened(x)
            again = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [mine.column(2).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                 pa.array(model.deviation(x), pa.int64()).take(pa.array(again)), pa.array(found.ravel(), mask=np.tile(~model.live, m)),
                 pa.array(np.tile(model.explained, m)), pa.array([errors[dim]] * (m * k), pa.float64())],
                ["vec_id", *(c.split()[0] for c in RESULT.split(", "))],
            )

    wanted = rows.where(F.col("dim").between(min(models), max(models)))
    return wanted.select("dim", "v", "vec_id").mapInArrow(run, f"vec_id {kind}, {RESULT}")
