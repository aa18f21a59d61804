"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

At each level a row draws once for every child, an exponential variate ``-ln(u) / weight`` whose ``u`` comes from a
hash of the row's key and the child's name, and descends into the child with the smallest draw. A child's draw depends
on its own weight alone, so a changed weight moves rows only into (or out of) the subtree that changed.

Capacity is added as a new region with its own rack and shard. No old subtree changes weight then, so every row that
moves goes to the new shard (law ``key``).

Defined results: a null key is hashed as the string ``null``; null text has size 1 and CRC 0; equal keys share a shard
and get different slots; an empty table gives no rows. Only the key and text columns are read, so further columns of any
name do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

#: Hash draws use 48 bits of MD5, which a double holds exactly.
DRAW_RANGE = float(2**48 + 1)
#: Slots are numbered within (shard, bucket); 4096 buckets of a shard bound the rows of one window.
BUCKET_HEX = 3


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2, base: int = 8) -> list[Shard]:
    """The first ``base`` shards fill regions of ``racks_per_region * shards_per_rack``; each later one is a region.

    Fewer shards than ``base`` are an error: the tree that grows to ``base`` would move rows between old shards.
    """
    if not 0 < base <= shards:
        raise ValueError("a tree has base shards at least; give the number it began with as base")
    per_region = racks_per_region * shards_per_rack
    first = [Shard(i // per_region, i % per_region // shards_per_rack, i) for i in range(min(shards, base))]
    regions = 1 + max((s.region for s in first), default=-1)
    return first + [Shard(regions + i, 0, base + i) for i in range(max(0, shards - base))]


def draw(key: Column, node: str, weight: float) -> Column:
    """An exponential variate of rate ``weight``; the child with the smallest one is taken."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{node}")).cast("binary")), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 1) / F.lit(DRAW_RANGE)) / F.lit(float(weight))


def _pick(key: Column, prefix: str, children: dict[int, float]) -> Column:
    if len(children) == 1:
        return F.lit(next(iter(children)))
    drawn = [F.struct(draw(key, f"{prefix}{c}", w).alias("d"), F.lit(c).alias("c")) for c, w in sorted(children.items())]
    return F.least(*drawn)["c"]


def place(key: Column, tree: list[Shard]) -> Column:
    """The shard of a key: a draw among regions, then racks, then shards."""

    def weights(rows: list[Shard], level: str) -> dict[int, float]:
        out: dict[int, float] = {}
        for s in rows:
            out[getattr(s, level)] = out.get(getattr(s, level), 0.0) + s.weight
        return out

    def descend(rows: list[Shard], levels: list[str], prefix: str) -> Column:
        children = weights(rows, levels[0])
        if len(levels) == 1:
            return _pick(key, f"{prefix}{levels[0]}", children)
        inner = {c: [s for s in rows if getattr(s, levels[0]) == c] for c in children}
        pick = _pick(key, f"{prefix}{levels[0]}", children)

        def branch(c: Column) -> Column:
            out = None
            for child, part in sorted(inner.items()):
                deeper = descend(part, levels[1:], f"{prefix}{levels[0]}{child}/")
                out = F.when(c == child, deeper) if out is None else out.when(c == child, deeper)
            return out

        return let(pick, branch) if len(children) > 1 else branch(pick)

    return descend(tree, ["region", "rack", "shard"], "")


def shard_documents(docs: DataFrame, shards: int = 8, base: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places every document, numbers the rows of each shard from 0, and tells where one more shard would put them.

    ``base`` is the number of shards that the tree began with. Slots follow (bucket of a hash of key and CRC, key, CRC).
    Counts of (shard, bucket) come from a pass of their own; their running totals (at most shards * 4096 rows) are joined
    back, so no task ever sorts a whole shard, nor all rows of a key that many texts share.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    placed = [
        F.col(id_col).alias("doc_id"),
        place(key, topology(shards, base=base)).cast("int").alias("shard"),
        place(key, topology(shards + 1, base=base)).cast("int").alias("grown_shard"),
        F.substring(F.md5(F.concat(F.lit("slot:"), key, F.lit(":"), crc.cast("string")).cast("binary")), 1, BUCKET_HEX).alias("bucket"),
    ]
    counts = docs.select(*placed).groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        *placed,
        (F.octet_length(text) + 1).cast("long").alias("size"),
        crc.cast("long").alias("text_crc32"),
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(within))
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("before") + F.col("at") - 1).cast("long").alias("slot"),
        "grown_shard",
    )
