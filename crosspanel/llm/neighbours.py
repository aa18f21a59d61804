"""Nearest neighbours by a block matrix join on int8 product tiles.

Every vector is scaled to length 1 and rounded to int8 with its own scale. Vectors are dealt to cells of bounded size; a cell
holds one group of queries and one group of candidates. The integer product of a tile, times the scales, is within
``e_q + |q'| * e_c`` of the true cosine, where ``e`` is the length of a rounding residue and ``q'`` the rounded query. Pairs whose
upper bound is below the query's k-th best lower bound so far are dropped; the survivors of a tile are computed again in doubles
there and then, and the best k of a query stay. A cell gives k rows a query at most, however close its vectors lie, and heaps
merge the cells. The bound makes the result exact, not approximate.

Of equal vectors only the ``k + 1`` smallest ids can be among the k nearest of a query, so no more of them are candidates.

Defined results: rows with a null id and vectors that are null, zero, or hold null or non-finite components take no part; equal
rows of one id count once, rows of one id with different vectors each (as queries and as candidates); vectors of another dimension
are never compared; a query is not its own candidate; equal scores go to the smaller id; fewer than k candidates give fewer rows;
an empty table gives none. Ids are whole numbers; other columns are not read but by the condition of a query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps

#: Vectors of one cell, at most about this many of each kind, and the side of a tile; bytes of a cell's vectors, and pairs computed at once.
QUERIES, CANDIDATES, TILE = 16_384, 32_768, 1024
CELL_BYTES, PAIRS = 128 << 20, 1 << 15
#: Covers the rounding of single-precision products of exact integers, and of the bounds themselves.
SLACK = 1e-5


def valid(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes from -127 to 127 of the unit vectors, their scales, lengths and the lengths of the residues."""
    top = np.abs(x).max(1, keepdims=True)
    unit = x / top / np.sqrt(((x / top) ** 2).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    whole = np.rint(unit / scale[:, None]).astype(np.int8)
    back = whole * scale[:, None]
    return whole, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosines of rows, in doubles."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def best_of_cell(q: dict[str, np.ndarray], c: dict[str, np.ndarray], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query rows, candidate ids, scores) of the k nearest candidates of each query, by query tile. q, c: row, id, code, v and bounds."""
    kind = np.float32 if q["code"].shape[1] * 127 * 127 < 2**24 else np.float64
    for a in range(0, len(q["id"]), TILE):
        mine = {x: y[a : a + TILE] for x, y in q.items()}
        asked, least = mine["code"].astype(kind), np.full(len(mine["id"]), -np.inf)
        who, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in range(0, len(c["id"]), TILE):
            tile = {x: y[b : b + TILE] for x, y in c.items()}
            near = (asked @ tile["code"].astype(kind).T) * (mine["scale"][:, None] * tile["scale"][None, :])
            near[mine["row"][:, None] == tile["row"][None, :]] = -np.inf
            wide = mine["off"][:, None] + mine["length"][:, None] * tile["off"][None, :] + SLACK
            lower = near - wide
            if lower.shape[1] >= k:  # k pairs of this tile are at least so near
                least = np.maximum(least, np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k])
            rows, cols = np.nonzero((near + wide >= least[:, None]) & (near > -np.inf))
            for at in range(0, len(rows), PAIRS):
                r, s = rows[at : at + PAIRS], cols[at : at + PAIRS]
                who, ids = np.concatenate([who, r]), np.concatenate([ids, tile["id"][s]])
                scores = np.concatenate([scores, exact(mine["v"][r], tile["v"][s])])
                order = np.lexsort((ids, -scores, who))
                who, ids, scores = who[order], ids[order], scores[order]
                first = np.searchsorted(who, who)  # where each query's pairs begin
                stays = np.arange(len(who)) - first < k
                who, ids, scores = who[stays], ids[stays], scores[stays]
            full = np.flatnonzero(np.bincount(who, minlength=len(least)) == k)
            ends = np.searchsorted(who, full, side="right") - 1
            least[full] = np.maximum(least[full], scores[ends] - SLACK)
        yield mine["row"][who], ids, scores


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    queries_per_cell: int = QUERIES, candidates_per_cell: int = CANDIDATES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest other rows, by cosine, of each row that is a query."""
    held = Steps(vectors.sparkSession)
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    real, width = ("float", 4) if single else ("double", 8)
    usable = vectors.where(F.col(id_col).isNotNull() & valid(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{real}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    # rows equal in id and vector are one row; -0.0 and 0.0 are equal
    rows = usable.groupBy("id", "v").agg(F.max("q").alias("q")).withColumn("row", F.xxhash64(F.lit("row"), "id", "v"))
    coded = held.keep(codes(rows.select("row", "id", "q", F.size("v").alias("dim"), F.xxhash64("v").alias("h"), "v")))
    n, n_queries, dim = coded.agg(F.count(F.lit(1)), F.count_if("q"), F.max("dim")).first()
    room = max(TILE, CELL_BYTES // ((width + 1) * (dim or 1)))
    c_groups, q_groups = -(-n // min(candidates_per_cell, room)) or 1, -(-n_queries // min(queries_per_cell, room)) or 1
    spread = lambda seed, m: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    alike = Window.partitionBy("h").orderBy("id")
    first = coded.select("h", "id", "row").withColumn("copy", F.row_number().over(alike)).where(F.col("copy") > k + 1).select("row")
    sent = ["row", "id", "v", "code", "scale", "length", "off"]
    asked = coded.where("q").select("dim", spread("q", q_groups).alias("qg"), every(c_groups).alias("cg"), *sent, F.lit(True).alias("q"))
    found = coded.join(first, "row", "left_anti").select("dim", every(q_groups).alias("qg"), spread("c", c_groups).alias("cg"), *sent, F.lit(False).alias("q"))

    def cell(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, dim = pa.Table.from_batches(list(batches)), key[0].as_py()
        is_q = rows.column("q").to_numpy()
        both = {x: rows.column(x).to_numpy() for x in ("row", "id", "scale", "length", "off")}
        both["code"] = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(-1, dim)
        both["v"] = np.frombuffer(b"".join(rows.column("v").to_pylist()), f"<f{width}").reshape(-1, dim)
        if is_q.any() and not is_q.all():
            for columns in best_of_cell({x: y[is_q] for x, y in both.items()}, {x: y[~is_q] for x, y in both.items()}, k):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row", "vec_id", "score"])

    parts = held.keep(asked.unionByName(found).groupBy("dim", "qg", "cg").applyInArrow(cell, "row long, vec_id long, score double"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heaps: dict[int, list[tuple[float, int]]] = {}
            for q, c, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                h = heaps.setdefault(q, [])
                if len(h) < k:
                    heapq.heappush(h, (s, -c))
                elif (s, -c) > h[0]:
                    heapq.heapreplace(h, (s, -c))
            best = [(q, -c, s) for q, h in heaps.items() for s, c in h]
            columns = list(zip(*best, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["row", "vec_id", "score"])

    # heaps over the rows as they lie, then over those of each query
    merged = parts.mapInArrow(merge, parts.schema) if c_groups > 1 else parts
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    best = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = coded.where("q").select("row", F.col("id").alias("query_id"))
    best = held.keep(best.join(names, "row").select("query_id", "rank", "vec_id", "score"))
    held.end(best)
    return best


def codes(vectors: DataFrame) -> DataFrame:
    """row, id, q, dim, h, v -> with code, scale, length and off; v as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                mine = batch.filter(pa.array(dims == dim))
                v = _matrix(mine.column(5), dim)
                whole, scale, length, off = quantise(v.astype(np.float64))
                raw, plain = (pa.array([row.tobytes() for row in x], pa.binary()) for x in (whole, v))
                yield pa.RecordBatch.from_arrays(
                    [*mine.columns[:5], plain, raw, pa.array(scale), pa.array(length), pa.array(off)],
                    ["row", "id", "q", "dim", "h", "v", "code", "scale", "length", "off"],
                )

    return vectors.mapInArrow(run, "row long, id long, q boolean, dim int, h long, v binary, code binary, scale double, length double, off double")
