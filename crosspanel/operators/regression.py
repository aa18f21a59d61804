"""Linear models from sums of products, and boosted trees.

The sums of products of a row's features are gathered as matrices: a task multiplies blocks of its rows, and hands on its matrix by
rows of it, which are added by row and salt, so that no task adds up the matrices of all others. One pass serves hundreds of features,
and any number of models: ridge and lasso read the sums, features squared, on the driver. ``by`` keeps sums apart, by period for example.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import PANEL, PanelSpec
from .evaluate import rank_ic

Cells = list[tuple[str, str, float]]
#: Rows multiplied at once; bytes of matrices that a task holds before it hands them on.
BLOCK, HELD = 4096, 64 << 20


def known_vectors(df: DataFrame, columns: list[str] | str, target: str, by: list[str], size: int) -> DataFrame:
    """by, x: features (columns, or one array column) and the target, of rows in which all of them are known."""
    y = F.col(target).cast("double")
    if isinstance(columns, str):
        x = F.concat(F.col(columns).cast("array<double>"), F.array(y))
    else:
        x = F.array(*[F.col(c).cast("double") for c in columns], y)
    return df.select(*by, x.alias("_x")).where((F.size("_x") == size) & F.forall("_x", lambda v: v.isNotNull()))


def gram(df: DataFrame, features: list[str], target: str, by: list[str], vector: str | None = None) -> DataFrame:
    """by, i, j, value: the sums of products that a linear model needs, additive over blocks. i and j name features, the target, or 1.

    ``vector`` names an array column that holds the features in place of columns of their names. Rows with a null among the features
    or the target, or an array of another length, take no part; a null in ``by`` is a group of its own.
    """
    names = ["1", *features, target]
    rows = known_vectors(df, vector or features, target, by, len(features) + 1)
    kind = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    parts, cells = f"{kind}_i int, _salt int, _part binary", f"{kind}i string, j string, value double"
    n_by = len(by)

    def out(sums: dict[tuple, np.ndarray], types: list[pa.DataType]) -> pa.RecordBatch:
        keys = list(zip(*sums, strict=True)) or [()] * (n_by + 2)
        columns = [*(pa.array(k, t) for k, t in zip(keys, [*types, pa.int32(), pa.int32()], strict=True)), pa.array([v.tobytes() for v in sums.values()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [*by, "_i", "_salt", "_part"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, sums, types = TaskContext.get().partitionId() % 64, {}, []
        for batch in batches:
            types = [c.type for c in batch.columns[:n_by]]
            codes, keys = np.zeros(batch.num_rows, np.int64), [()]
            for column in batch.columns[:n_by]:
                d = column.dictionary_encode("encode")
                codes = codes * len(d.dictionary) + d.indices.to_numpy()
                keys = [(*k, v) for k in keys for v in d.dictionary.to_pylist()]
            z = batch.column(n_by).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(names) - 1)
            z = np.column_stack([np.ones(len(z)), z])
            for code in np.unique(codes).tolist():
                mine = z[codes == code]
                for at in range(0, len(mine), BLOCK):
                    block = mine[at : at + BLOCK]
                    g = block.T @ block
                    sums[keys[code]] = sums[keys[code]] + g if keys[code] in sums else g
                if len(sums) * len(names) ** 2 * 8 > HELD:
                    yield out({(*k, i, salt): m[i, i:] for k, m in sums.items() for i in range(len(names))}, types)
                    sums = {}
        if sums:
            yield out({(*k, i, salt): m[i, i:] for k, m in sums.items() for i in range(len(names))}, types)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, types = {}, []
        for batch in batches:
            types = [c.type for c in batch.columns[:n_by]]
            for *key, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine, at = np.frombuffer(raw), tuple(key)
                sums[at] = sums[at] + mine if at in sums else mine
        if sums:
            yield out(sums, types)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(names, pa.string())
        for batch in batches:
            rows = [np.frombuffer(raw) for raw in batch.column(n_by + 2).to_pylist()]
            first = batch.column(n_by).to_numpy()
            again = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
            j = np.concatenate([np.zeros(0, np.int64), *(np.arange(i, i + len(r)) for i, r in zip(first, rows, strict=True))])
            value = np.concatenate([np.zeros(0), *rows])
            columns = [*(c.take(again) for c in batch.columns[:n_by]), labels.take(batch.column(n_by).take(again)), labels.take(pa.array(j)), pa.array(value)]
            yield pa.RecordBatch.from_arrays(columns, [*by, "i", "j", "value"])

    once = rows.mapInArrow(multiply, parts).repartition(*[F.col(b) for b in by], "_i", "_salt").mapInArrow(add, parts)
    every = once.withColumn("_salt", F.lit(0)).repartition(*[F.col(b) for b in by], "_i").mapInArrow(add, parts)
    return every.mapInArrow(name, cells)


class Sums:
    """Means, deviations, correlations and cross products of features with a target, from the cells of ``gram``."""

    def __init__(self, cells: Cells, features: list[str], target: str):
        place = {f: k for k, f in enumerate(["1", *features, target])}
        g = np.zeros((len(place), len(place)))
        for i, j, v in cells:
            g[place[i], place[j]] = g[place[j], place[i]] = v
        self.features, self.n = features, g[0, 0]
        self.mean, self.y = g[0, 1:-1] / self.n, g[0, -1] / self.n
        covariance = g[1:-1, 1:-1] / self.n - np.outer(self.mean, self.mean)
        self.deviation = np.sqrt(np.maximum(np.diag(covariance), 1e-18))
        self.correlation = covariance / np.outer(self.deviation, self.deviation)
        self.cross = (g[1:-1, -1] / self.n - self.mean * self.y) / self.deviation

    def weights(self, standard: np.ndarray) -> tuple[dict[str, float], float]:
        """Weights of the columns as they stand, and the intercept, from those of standardised ones."""
        beta = standard / self.deviation
        return dict(zip(self.features, beta.tolist(), strict=True)), float(self.y - beta @ self.mean)


def ridge(cells: Cells, features: list[str], target: str, alpha: float) -> tuple[dict[str, float], float]:
    """Coefficients and intercept of a ridge on standardised features."""
    s = Sums(cells, features, target)
    return s.weights(np.linalg.solve(s.correlation + alpha / s.n * np.eye(len(features)), s.cross))


def lasso_path(cells: Cells, features: list[str], target: str, alphas: list[float], within: float = 1e-10, rounds: int = 100_000) -> list[tuple[float, dict[str, float], float]]:
    """(alpha, weights, intercept) of the lasso of standardised features for each alpha, from the largest one down.

    Coordinate descent on the sums: each weight is the soft-thresholded slope of what the others leave, features that stay 0 cost
    nothing until the others have settled, and each alpha starts from the weights of the one before.
    """
    s, out = Sums(cells, features, target), []
    w, slope = np.zeros(len(features)), s.cross.copy()  # slope: what is left for each feature
    scale = np.maximum(np.diag(s.correlation), 0.0)
    for alpha in sorted(alphas, reverse=True):
        every = True
        for _ in range(rounds):
            moved = 0.0
            for j in np.flatnonzero(scale > 0.5) if every else np.flatnonzero(w):
                free = slope[j] + scale[j] * w[j]
                new = np.sign(free) * max(abs(free) - alpha, 0.0) / scale[j]
                if (step := new - w[j]) != 0:
                    w[j] = new
                    slope -= step * s.correlation[:, j]
                    moved = max(moved, abs(step))
            if every and moved <= within:
                break
            every = moved <= within
        out.append((alpha, *s.weights(w)))
    return out


def scored(df: DataFrame, models: list[tuple[float, dict[str, float], float]], spec: PanelSpec, target: str, vector: str | None = None, features: list[str] | None = None) -> DataFrame:
    """entity, date, target, alpha, score: every model's scores in one pass; missing values count as 0."""

    def score(weights: dict[str, float], intercept: float) -> Column:
        if vector is not None:
            w = F.array(*[F.lit(float(weights[f])) for f in features])
            return F.aggregate(F.zip_with(vector, w, lambda a, b: F.coalesce(a, F.lit(0.0)) * b), F.lit(float(intercept)), lambda a, x: a + x)
        return reduce(lambda a, x: a + F.coalesce(F.col(x[0]), F.lit(0.0)) * F.lit(float(x[1])), ((f, w) for f, w in weights.items() if w), F.lit(float(intercept)))

    each = F.array(*[F.struct(F.lit(float(alpha)).alias("alpha"), F.round(score(w, c), 10).alias("score")) for alpha, w, c in models])
    return df.select(spec.entity, spec.date, target, F.explode(each).alias("_m")).select(spec.entity, spec.date, target, "_m.*")


def early_stop(ics: list[tuple[float, float | None]], patience: int) -> float:
    """The alpha of the best value before ``patience`` values in a row did not better it, from the largest alpha down."""
    best, since = None, 0
    for alpha, ic in sorted(ics, reverse=True):
        if best is None or (ic if ic is not None else -9.0) > best[1]:
            best, since = (alpha, ic if ic is not None else -9.0), 0
        elif (since := since + 1) >= patience:
            break
    return best[0]


def lasso(train: DataFrame, valid: DataFrame, features: list[str], target: str, alphas: list[float], least: int, patience: int = 3, spec: PanelSpec = PANEL) -> tuple[dict[str, float], float, DataFrame]:
    """Weights and intercept of the lasso whose alpha does best on the validation rows, fitted on both; and alpha, ic, nonzero, chosen.

    The sums of the final fit are those of training and validation added: no row is read for it again.
    """
    spark = train.sparkSession
    read = lambda df: {(r.i, r.j): r.value for r in gram(df, features, target, []).collect()}  # noqa: E731  features squared
    of_train, of_valid = read(train), read(valid)
    path = lasso_path([(*k, v) for k, v in of_train.items()], features, target, alphas)
    daily = rank_ic(scored(valid, path, spec, target), "score", target, least, "ic", ("alpha",), spec)
    ics = {r.alpha: r.ic for r in daily.groupBy("alpha").agg(F.avg("ic").alias("ic")).collect()}
    best = early_stop([(a, ics.get(a)) for a, _, _ in path], patience)
    both = [(*k, of_train.get(k, 0.0) + of_valid.get(k, 0.0)) for k in of_train.keys() | of_valid.keys()]
    final = lasso_path(both, features, target, [a for a in alphas if a >= best])[-1]
    report = spark.createDataFrame([(a, ics.get(a), sum(x != 0 for x in w.values()), a == best) for a, w, _ in path], "alpha double, ic double, nonzero int, chosen boolean")
    return final[1], final[2], report


def boosted_trees(df: DataFrame, features: list[str], target: str, valid: Column, out: str, rounds: int = 40, depth: int = 4, rate: float = 0.1, seed: int = 7) -> DataFrame:
    """The rows with ``out``, the score of boosted regression trees fitted on rows with a target, stopped early on the validation ones.

    Missing features count as 0. Trees are grown by the ML library, which bins features and adds up histograms over all partitions.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    filled = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    rows = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="_vector").transform(filled).drop(*[f"_f_{c}" for c in features])
    fit = rows.where(F.col(target).isNotNull()).withColumn("_valid", F.coalesce(valid, F.lit(False))).withColumn("_target", F.col(target).cast("double"))
    trees = GBTRegressor(featuresCol="_vector", labelCol="_target", predictionCol=out, validationIndicatorCol="_valid", maxIter=rounds, maxDepth=depth, stepSize=rate, validationTol=0.001, seed=seed)
    return trees.fit(fit).transform(rows).drop("_vector")
