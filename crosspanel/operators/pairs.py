"""The best partners of each entity among all others, by cells of blocks of entities.

Entities are dealt to blocks; a cell holds two of them and looks at all their pairs by matrix products, a tile at a time. Only the best
few of each entity leave a cell, so memory is that of a cell and rows on disk grow with the entities times the number of blocks, not with
the pairs. The work itself is quadratic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import written

#: Bytes of one side of a cell; rows and columns of a tile.
HELD, ROWS, COLUMNS = 48 << 20, 1024, 2048


def block_count(n: int, row_bytes: int, block: int) -> int:
    """Blocks of ``n`` entities: eight if that fits a cell, fewer if blocks would be smaller than ``block``."""
    size = max(256, min(HELD // max(row_bytes, 1), max(block, -(-n // 8))))
    return -(-n // size) or 1


class Best:
    """The ``k`` best partners so far of each of ``n`` entities: largest weight first, then smallest rank."""

    def __init__(self, n: int, k: int):
        self.k, self.w, self.rank = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    @property
    def last(self) -> np.ndarray:
        return self.w[:, -1]

    def add(self, node: np.ndarray, rank: np.ndarray, w: np.ndarray) -> None:
        own = np.unique(node)
        node = np.concatenate([np.repeat(own, self.k), node])
        rank, w = np.concatenate([self.rank[own].ravel(), rank]), np.concatenate([self.w[own].ravel(), w])
        order = np.lexsort((rank, -w, node))
        node, rank, w = node[order], rank[order], w[order]
        place = np.arange(len(node)) - np.searchsorted(node, node)
        keep = place < self.k
        self.w[node[keep], place[keep]], self.rank[node[keep], place[keep]] = w[keep], rank[keep]

    def edges(self, mine: pa.Array, others: pa.Array, kind: pa.DataType) -> pa.Table:
        """src, dst, weight; ``others`` in order of rank."""
        r, c = np.nonzero(self.w > -np.inf)
        return pa.table({"src": mine.take(pa.array(r)), "dst": others.take(pa.array(self.rank[r, c])), "weight": pa.array(self.w[r, c]).cast(kind)})


def _packed(dates: int):
    """Series as bytes of ``dates`` doubles: NaN where there is no value, infinity for one that is not finite."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, HELD // (16 * dates))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                xs = part.column(1)
                row, flat = np.repeat(np.arange(part.num_rows), pc.list_value_length(xs).to_numpy()), xs.flatten()
                x = flat.field("x").to_numpy(zero_copy_only=False)
                v = np.full((part.num_rows, dates), np.nan)
                v[row, flat.field("_k").to_numpy()] = np.where(np.isfinite(x), x, np.inf)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in v], pa.binary())], ["id", "v"])

    return pack


def _standard(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Series around their means with a sum of squares of 1, zeros for no value; the mask of values; and series with odd values."""
    m, odd = ~np.isnan(v), np.isinf(v)
    x = np.where(m & ~odd, v, 0.0)
    mean = x.sum(1, keepdims=True) / np.maximum((m & ~odd).sum(1, keepdims=True), 1)
    x = np.where(m & ~odd, x - mean, 0.0)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return (x / np.where(norm > 0, norm, 1.0)).astype(np.float32), m.astype(np.float32), odd.any(1)


def _exact(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Correlations of the rows of x and y over common values; NaN for fewer than ``least`` or where one is constant."""
    m = ~(np.isnan(x) | np.isnan(y))
    n = m.sum(1)
    out = []
    with np.errstate(all="ignore"):
        for v in (x, y):
            v = np.where(m, v, 0.0)
            d = np.where(m, v - (v.sum(1) / n)[:, None], 0.0)
            s = (d * d).sum(1)
            out += [d, np.where(s > 1e-24 * (v * v).sum(1), s, np.nan)]
        return np.where(n >= least, (out[0] * out[2]).sum(1) / (np.sqrt(out[1]) * np.sqrt(out[3])), np.nan)


def _may_pass(x, y, t: np.ndarray, least: int, dates: int) -> np.ndarray:
    """Pairs of a tile whose correlation may be above t: single precision, less what its sums can be wrong by."""
    (a, ma, odd_a), (b, mb, odd_b) = x, y
    wrong = np.float32(4 * (dates + 8) * 2.0**-24)
    n, sa, sb, cov = ma @ mb.T, a @ mb.T, ma @ b.T, a @ b.T
    va, vb = (a * a) @ mb.T, ma @ (b * b).T
    inverse = 1 / np.maximum(n, 1)
    cov -= sa * sb * inverse
    va -= sa * sa * inverse
    vb -= sb * sb * inverse
    bound = t * np.sqrt(np.maximum(va - wrong, 0) * np.maximum(vb - wrong, 0))
    if (t < 0).any():
        bound = np.where(t < 0, t * np.sqrt(np.maximum(va + wrong, 0) * np.maximum(vb + wrong, 0)), bound)
    return ((cov + wrong > bound) | odd_a[:, None] | odd_b[None, :]) & (n >= least)


def best_correlations(series: DataFrame, dates: int, threshold: float, top: int, least: int, digits: int, block: int) -> DataFrame:
    """src, dst, weight: for each id the ``top`` others of every block whose correlation, rounded, is above the threshold.

    ``series`` has id and xs, an array of (_k, x): the value at each place of the ``dates`` that has one. Tiles are sifted in single
    precision with a bound on its error; what may be among the best is computed again in double precision, each pair around its own means.
    """
    kind = series.schema["id"].dataType.simpleString()
    packed = written(series.where((F.size("xs") >= least) & F.col("id").isNotNull()).mapInArrow(_packed(dates), f"id {kind}, v binary"))
    groups = block_count(packed.count(), 8 * dates, block)
    mine, other = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_o")
    dealt = packed.select("id", "v", mine.alias("_b"), other)
    side = F.when(F.col("_b") < F.col("_o"), 0).when(F.col("_b") > F.col("_o"), 1).otherwise(2)
    dealt = dealt.select(F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), side.alias("side"), "id", "v")
    unit = 10.0**-digits

    def cell(table: pa.Table) -> pa.Table:
        side, ids, raw = table.column("side").to_numpy(), table.column("id").combine_chunks(), table.column("v").combine_chunks()
        v = np.frombuffer(b"".join(x.as_buffer() for x in raw), np.float64).reshape(-1, dates)
        at = pc.sort_indices(ids)
        rank = np.empty(len(ids), np.int64)
        rank[at.to_numpy()] = np.arange(len(ids))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        one = bool(len(side)) and side[0] == 2  # a block with itself
        of_left, of_right = Best(len(left), top), Best(len(right), top)
        limit = lambda best: (np.maximum(best, threshold) - unit).astype(np.float32) - np.float32(1e-6)
        for r in range(0, len(left), ROWS):
            mine = left[r : r + ROWS]
            x = _standard(v[mine])
            for c in range(0, len(right), COLUMNS):
                others = right[c : c + COLUMNS]
                t = limit(of_left.last[r : r + ROWS])[:, None]
                if not one:
                    t = np.minimum(t, limit(of_right.last[c : c + COLUMNS])[None, :])
                may = _may_pass(x, _standard(v[others]), t, least, dates)
                if one:
                    may &= mine[:, None] != others[None, :]
                p, q = np.nonzero(may)
                step = max(1, HELD // (32 * dates))
                rho = np.concatenate([np.zeros(0), *(_exact(v[mine[p[k : k + step]]], v[others[q[k : k + step]]], least) for k in range(0, len(p), step))])
                rho = np.round(rho, digits)
                good = rho > threshold
                p, q, rho = p[good], q[good], rho[good]
                if len(p):
                    of_left.add(p + r, rank[others[q]], rho)
                    if not one:
                        of_right.add(q + c, rank[mine[p]], rho)
        found, sorted_ids = [of_left.edges(ids.take(pa.array(left)), ids.take(at), pa.float64())], ids.take(at)
        if not one:
            found.append(of_right.edges(ids.take(pa.array(right)), sorted_ids, pa.float64()))
        return pa.concat_tables(found)

    return dealt.repartition(groups * (groups + 1) // 2, "i", "j").groupBy("i", "j").applyInArrow(cell, f"src {kind}, dst {kind}, weight double")


def best_shared(members: DataFrame, asked: DataFrame, top: int, block: int) -> DataFrame:
    """src, dst, weight: for each id asked for the ``top`` others of every block that share most groups with it.

    Both tables have id and groups, an array of the id's groups. Counts are whole numbers in single precision, exact up to 2**24.
    """
    kind = members.schema["id"].dataType.simpleString()
    n, entries = members.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("groups")), F.lit(0))).first()
    blocks = max(block_count(n, 0, block), -(-entries // (HELD // 16)))
    mine, every = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    src = asked.select(mine.alias("i"), every.alias("j"), F.lit(True).alias("src"), "id", "groups")
    dst = members.select(every.alias("i"), mine.alias("j"), F.lit(False).alias("src"), "id", "groups")

    def incidence(codes: np.ndarray, ends: np.ndarray, at: int, rows: int, low: int, high: int) -> np.ndarray:
        """How often each of the rows from ``at`` has each of the groups from ``low``."""
        a, b = ends[at], ends[min(at + rows, len(ends) - 1)]
        row, code = np.repeat(np.arange(min(rows, len(ends) - 1 - at)), np.diff(ends[at : at + rows + 1])), codes[a:b]
        inside = (code >= low) & (code < high)
        flat = row[inside] * (high - low) + code[inside] - low
        return np.bincount(flat, minlength=(min(rows, len(ends) - 1 - at)) * (high - low)).astype(np.float32).reshape(-1, high - low)

    def cell(table: pa.Table) -> pa.Table:
        is_src, ids = table.column("src").to_numpy(), table.column("id").combine_chunks()
        left = np.flatnonzero(is_src)
        right = np.flatnonzero(~is_src)
        right = right[pc.sort_indices(ids.take(pa.array(right))).to_numpy()]
        lists = table.column("groups").combine_chunks()
        sides = [lists.take(pa.array(x)) for x in (left, right)]
        flat = [x.flatten() for x in sides]
        ends = [np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy())]).astype(np.int64) for x in sides]
        names = pc.unique(flat[1])  # a group that one side lacks adds nothing
        names = names.filter(pc.is_in(names, value_set=pc.unique(flat[0])))
        codes = [pc.fill_null(pc.index_in(x, value_set=names), -1).to_numpy() for x in flat]
        itself = pc.fill_null(pc.index_in(ids.take(pa.array(left)), value_set=ids.take(pa.array(right))), -1).to_numpy()
        best = Best(len(left), top)
        for r in range(0, len(left), ROWS):
            rows = min(ROWS, len(left) - r)
            for c in range(0, len(right), COLUMNS):
                shared = np.zeros((rows, min(COLUMNS, len(right) - c)), np.float32)
                for low in range(0, len(names), COLUMNS):
                    high = min(low + COLUMNS, len(names))
                    shared += incidence(codes[0], ends[0], r, ROWS, low, high) @ incidence(codes[1], ends[1], c, COLUMNS, low, high).T
                own = itself[r : r + rows] - c
                here = np.flatnonzero((own >= 0) & (own < shared.shape[1]))
                shared[here, own[here]] = 0
                p, q = np.nonzero(shared > np.maximum(best.last[r : r + rows], 0)[:, None])  # later ones lose ties
                if len(p) > 16 * top * rows:
                    order = shared.astype(np.float64) * shared.shape[1] - np.arange(shared.shape[1])
                    q = np.argpartition(-order, top - 1, axis=1)[:, :top].ravel()
                    p = np.repeat(np.arange(rows), top)
                    p, q = p[shared[p, q] > 0], q[shared[p, q] > 0]
                if len(p):
                    best.add(p + r, q + c, shared[p, q].astype(np.float64))
        return best.edges(ids.take(pa.array(left)), ids.take(pa.array(right)), pa.int64())

    dealt = src.unionByName(dst).repartition(blocks * blocks, "i", "j")
    return dealt.groupBy("i", "j").applyInArrow(cell, f"src {kind}, dst {kind}, weight long")
