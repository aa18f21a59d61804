"""Exact Jaccard self-join of word-shingle sets by a size-aware heavy-light join, and the components of its links.

Equal sets are joined first and go on as one set. Then two ways, split by cost:

* Light: a small set enumerates its subsets that lack up to a fifth of it. Two sets of Jaccard 0.8 share the subset that
  is their intersection, and it alone proves the link, so each subset's list is a star around its smallest set.
* Heavy: a larger set puts the first ``n - ceil(0.8 n) + 1`` shingles of a fixed total order into inverted lists; linked sets
  meet in one list at least. Sets down to four fifths of the boundary go both ways, to meet partners beyond it.

One pass over all documents counts the shingles in ``2**SKETCH_BITS`` hash buckets, and the sizes of small sets. The order of
shingles is by the power of two of their bucket's count, then by hash: rare ones come first, so passages shared by many
documents make few long lists. The boundary is the size at which the estimated rows of both ways are fewest. A bucket counts
at least what each of its shingles counts, so a list from a bucket under ``2**LONG`` has fewer rows than that and is one
window's work; the others go by partial aggregates and joins. Order, boundary and ``LONG`` change cost only, never the result.

A pair's two sizes say how much overlap it needs, hence how early in both orders its first common shingle stands; a pair
meets in a list only if both stand early enough there. Lists are scanned in two steps. First every set of a list is tested
against two leaders: the sets that have this shingle earliest and latest. The earliest has the fewest shingles of its own, as
the middle of a group of near copies does, so this joins most groups with a few tests per document. Then only pairs from
different components are left: each document outside a list's largest component meets those sets of the list whose size and
place allow a link, by an equality join on size bands. Whole sets decide each pair. No pair is dropped for any other reason.

Before whole sets are read, parities of a bit or two a shingle rule out most pairs that differ in too many shingles.

A list with many sets outside its largest component, and many pairs of them to look at, has a shingle that sets share without being similar, such as a header's, which
the counts by bucket have not told from rare ones. Such shingles are known exactly by then: they move to the end of the order, the
sets that had one in their prefix get a new prefix, and the lists are made again, until no such list is left or sets have no other shingles.

Defined results: texts without words (or null) have size 0 and are their own component; a null id is linked like any other
and its component is the smallest id in it that is not null, null if there is none; repeated rows of one id give equal rows;
an empty table gives no rows. Only id and text are read; ids keep their type. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, few, fresh, steps
from .components import components
from .shingles import MASK, mix, shingle_sets

#: Buckets of the count of shingles: one byte each is sent to the executors.
SKETCH_BITS = 21
#: Counters that one row of the sketch holds.
CHUNK = 1 << 15
#: Lists from buckets that count 2**LONG or more are brought together by partial aggregates.
LONG = 12
#: The boundary lies between these sizes; a test of a pair costs about as much as so many rows of a list.
LEAST, MOST, TEST = 4, 19, 40


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def subset_count(n: int) -> int:
    return sum(comb(n, lacking) for lacking in range(n // 5 + 1))


def boundary(sizes: np.ndarray, shared: float) -> tuple[int, int]:
    """(largest size that enumerates subsets, smallest size in the lists) with the fewest rows.

    ``sizes[n]``: documents of n shingles; ``shared``: the share of lists that hold two sets or more, each tested twice.
    """
    heavy = lambda n: prefix_length(n) * (1 + 2 * TEST * shared)

    def cost(b: int) -> float:
        light = sum(int(sizes[n]) * subset_count(n) for n in range(1, b + 1))
        return light + sum(int(sizes[n]) * heavy(n) for n in range((4 * (b + 1) + 4) // 5, MOST + 1))

    small = min(range(LEAST, MOST + 1), key=cost)
    return small, (4 * (small + 1) + 4) // 5


@lru_cache(maxsize=64)
def _lacking(n: int, gone: int) -> np.ndarray:
    return np.array(list(combinations(range(n), gone)), np.int64).reshape(comb(n, gone), gone)


def subset_keys(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and sizes of the subsets of a small set that lack up to a fifth of it; a subset's hash is a sum."""
    spread = mix(s)
    total, keys, sizes = spread.sum(dtype=np.uint64), [], []
    for gone in range(len(s) // 5 + 1):
        left = total - spread[_lacking(len(s), gone)].sum(1, dtype=np.uint64)
        keys.append(left ^ np.uint64(len(s) - gone))
        sizes.append(np.full(len(left), len(s) - gone, np.int32))
    return _signed(np.concatenate(keys)), np.concatenate(sizes)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _lists(arrays: list[np.ndarray], kind: pa.DataType, dtype) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype), *arrays]).astype(dtype), kind))


def set_hash(s: np.ndarray) -> int:
    """One signed 64-bit hash of a whole set."""
    x = (int(mix(s).sum(dtype=np.uint64)) + len(s)) & MASK
    for _ in range(2):  # the same bijection as mix
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & MASK
    x ^= x >> 32
    return x - (x >> 63 << 64)


def parity(s: np.ndarray) -> np.ndarray:
    """Whether each of about as many buckets as the set has shingles holds an odd number of them, as bits of 64-bit words.

    The number of words is a power of two; a longer one folds to a shorter one, half on half. Two sets differ in as many shingles
    at least as their bits do.
    """
    wide = 1 << max(0, -(-len(s) // 64) - 1).bit_length()
    bits = np.zeros(wide, np.uint64)
    np.bitwise_xor.at(bits, ((s >> np.uint64(6)) & np.uint64(wide - 1)).astype(np.int64), np.uint64(1) << (s & np.uint64(63)))
    return _signed(bits)


def _buckets(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def packed(counts: np.ndarray) -> bytes:
    """``CHUNK`` counters by planes of equal bytes, of which most are zeros, compressed."""
    return pa.compress(np.ascontiguousarray(counts.astype("<i8").view("u1").reshape(-1, 8).T), codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * CHUNK, codec="zstd", asbytes=True), "u1").reshape(8, CHUNK)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def shingle_counts(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the shingles of all documents by bucket, repeats in a document included, and of documents by size up to ``MOST``.

    Each task counts its own documents; the tasks' counters are added in two steps, so that no task reads those of all.
    """
    size = 1 << SKETCH_BITS
    rows = "chunk int, salt int, counts binary"

    def row(chunk: int, salt: int, counts: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array([chunk], pa.int32()), pa.array([salt], pa.int32()), pa.array([packed(counts)], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["chunk", "salt", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros(size, np.uint32), np.zeros(CHUNK, np.int64)
        for batch in steps(batches, 0):
            sets = shingle_sets(batch.column(0).to_pylist(), k, distinct=False)
            for at in range(0, len(sets), 1024):
                found, n = np.unique(_buckets(np.concatenate(sets[at : at + 1024])), return_counts=True)
                counts[found] += n.astype(np.uint32)
            lengths = np.array([len(s) for s in sets], np.int64)
            sizes += np.bincount(lengths[lengths <= MOST], minlength=CHUNK)
        salt = TaskContext.get().partitionId() % 64
        if sizes.any() or counts.any():
            yield row(-1, salt, sizes)
        for chunk in range(size // CHUNK):
            if (mine := counts[chunk * CHUNK : (chunk + 1) * CHUNK]).any():
                yield row(chunk, salt, mine)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for chunk, salt, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = unpacked(raw)
                sums[chunk, salt] = sums[chunk, salt] + mine if (chunk, salt) in sums else mine
        for (chunk, salt), counts in sums.items():
            yield row(chunk, salt, counts)

    once = docs.select("text").mapInArrow(count, rows).repartition("chunk", "salt").mapInArrow(add, rows)
    every = once.withColumn("salt", F.lit(0)).repartition("chunk").mapInArrow(add, rows)
    counts, sizes = np.zeros(size, np.int64), np.zeros(MOST + 1, np.int64)
    for r in every.collect():  # the sketch alone, whatever the corpus
        mine = unpacked(r.counts)
        if r.chunk < 0:
            sizes += mine[: MOST + 1]
        else:
            counts[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] += mine
    return counts, sizes


def signatures(docs: DataFrame, k: int, levels: np.ndarray, small: int, large: int) -> DataFrame:
    """row, doc_id, n, h (hash of the whole set), odd (its parity), keys and long of the inverted lists, subs and sizes of small sets' subsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in steps(batches, 2):
            n, h, odd, keys, long, subs, sizes = [], [], [], [], [], [], []
            for s in shingle_sets(batch.column(2).to_pylist(), k):
                n.append(len(s))
                h.append(set_hash(s))
                mine, level = s[:0], none
                odd.append(parity(s) if len(s) >= large else none)
                if len(s) >= large:
                    level = levels[_buckets(s)]
                    first = np.argsort(level, kind="stable")[: prefix_length(len(s))]  # the set is in order of hash
                    mine, level = s[first], level[first]
                keys.append(_signed(mine))
                long.append(level > LONG)
                of, size = subset_keys(s) if 0 < len(s) <= small else (none, none)
                subs.append(of)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(h, pa.int64()), _lists(odd, pa.int64(), np.int64), _lists(keys, pa.int64(), np.int64),
                 _lists(long, pa.bool_(), np.bool_), _lists(subs, pa.int64(), np.int64), _lists(sizes, pa.int32(), np.int32)],
                ["row", "doc_id", "n", "h", "odd", "keys", "long", "subs", "sizes"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n int, h long, odd array<long>, keys array<long>, long array<boolean>, subs array<long>, sizes array<int>"
    return docs.select("row", "doc_id", "text").mapInArrow(run, schema)


def small_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) of small sets: in each subset's list, the smallest set with every set that the subset proves."""
    rows = sets.select("h", "n", F.explode(F.arrays_zip("subs", "sizes")).alias("x")).select("h", "n", F.col("x.subs").alias("key"), F.col("x.sizes").alias("size"))
    least = rows.groupBy("key", "size").agg(F.min(F.struct("n", "h")).alias("m"), F.max("h").alias("last"), F.min("h").alias("first")).where("first <> last")
    return rows.join(least, ["key", "size"]).where("h <> m.h and 180 * size >= 80 * (n + m.n)").select(F.col("m.h").alias("a"), F.col("h").alias("b"))


def meets(n_a: str, pos_a: str, n_b: str, pos_b: str) -> Column:
    """Whether two sets of these sizes may be linked and have their first common shingle at these places (from 0).

    A linked pair needs ``need = ceil(4 (n_a + n_b) / 9)`` common shingles. If the first of them in the order stood later than
    ``n - need`` in one set, too few shingles would follow it there.
    """
    need = f"((4 * ({n_a} + {n_b}) + 8) div 9)"
    return near_sizes(n_a, n_b) & F.expr(f"{pos_a} + {need} <= {n_a} and {pos_b} + {need} <= {n_b}")


def near_sizes(n_a: str, n_b: str) -> Column:
    return F.expr(f"5 * least({n_a}, {n_b}) >= 4 * greatest({n_a}, {n_b})")


def one_each(sig: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of signatures, one of each set. Only those of sets that several rows have are moved, if there are few such sets."""
    several = few(members.where("copies > 1").select("h"))
    return sig.join(several, "h", "left_anti").unionByName(sig.join(several, "h", "left_semi").dropDuplicates(["h"]))


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sets' parities do not rule out.

    Linked sets differ in a ninth of ``n_a + n_b`` shingles at most, so no more of their bits may differ. Sizes as near as a pair's
    have as many words or twice as many.
    """
    asked = few(pairs.select("a", "b"))
    one = asked.join(sets.select(F.col("h").alias("a"), F.col("n").alias("n_a"), F.col("odd").alias("x")), "a")
    two = asked.join(sets.select(F.col("h").alias("b"), F.col("n").alias("n_b"), F.col("odd").alias("y")), "b")

    def folded(x: str, y: str) -> Column:
        low, high = F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y))
        return F.when(F.size(x) > F.size(y), F.zip_with(low, high, lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))

    apart = F.aggregate(F.zip_with(folded("x", "y"), folded("y", "x"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)
    return one.join(two, ["a", "b"]).where(F.coalesce(apart, F.lit(0)) * 9 <= F.col("n_a") + F.col("n_b")).select("a", "b")


def tested(docs: DataFrame, members: DataFrame, pairs: DataFrame, k: int, held: Steps) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity is 0.8 or more, by their whole sets.

    A set's text is read from one of its documents. The keys of those documents are broadcast if they are few, a join
    otherwise, so only the texts that matter are shingled and moved. Sets meet in the JVM, one pair at a time.
    """
    needed = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    wanted = held.keep(members.join(needed, "h", "left_semi").select("h", F.col("rep").alias("row")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            hashes, sets = [], []
            for h, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), k), strict=True):
                if set_hash(s) == h and h not in hashes[-1:]:
                    hashes.append(h)
                    sets.append(_signed(s))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), _lists(sets, pa.int64(), np.int64)], ["h", "s"])

    shingled = docs.join(few(wanted), "row").select("h", "text").mapInArrow(run, "h long, s array<long>")
    once = shingled.groupBy("h").agg(F.first("s").alias("s"))  # a repeated row has one key
    first = pairs.select("a", "b").join(once.select(F.col("h").alias("a"), F.col("s").alias("x")), "a")
    both = first.join(once.select(F.col("h").alias("b"), F.col("s").alias("y")), "b")
    return both.where("180 * size(array_intersect(x, y)) >= 80 * (size(x) + size(y))").select("a", "b").distinct()


def prefix_rows(sig: DataFrame, members: DataFrame) -> DataFrame:
    """key, long, h, n, pos of the prefix of every larger set."""
    reps = one_each(sig.where(F.size("keys") > 0).select("h", "n", "keys", "long"), members)
    listed = reps.select("h", "n", F.posexplode(F.arrays_zip("keys", "long")).alias("pos", "x"))
    return listed.select(F.col("x.keys").alias("key"), F.col("x.long").alias("long"), "h", "n", "pos")


def inverted_lists(rows: DataFrame) -> DataFrame:
    """key, h, n, pos of the lists with two sets or more, with two leaders (pos, h, n) of each list."""
    whole = Window.partitionBy("key")
    ends = [F.min(F.struct("pos", "h", "n")), F.max(F.struct("pos", "h", "n"))]
    short = rows.where("not long").select("key", "h", "n", "pos", ends[0].over(whole).alias("p"), ends[1].over(whole).alias("q"))
    often = rows.where("long")
    many = often.join(often.groupBy("key").agg(ends[0].alias("p"), ends[1].alias("q")), "key").select("key", "h", "n", "pos", "p", "q")
    return short.unionByName(many).where("p.h <> q.h")


def leader_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of a set and a leader that may have their first common shingle here."""
    asked = lists.select("h", "n", "pos", F.explode(F.array("p", "q")).alias("m")).where("m.h <> h")
    return asked.where(meets("n", "pos", "m.n", "m.pos")).select(F.least("h", "m.h").alias("a"), F.greatest("h", "m.h").alias("b")).distinct()


#: Sizes whose logarithms to this base have one whole part are one band.
BAND = 1.1


def placed_lists(lists: DataFrame, roots: DataFrame, held: Steps) -> tuple[DataFrame, DataFrame]:
    """The lists' rows with their component, and key, major (the largest component) and minor (rows of others) of mixed lists."""
    placed = held.keep(lists.join(roots.select(F.col("node").alias("h"), "root"), "h", "left").select("key", "h", "n", "pos", F.coalesce("root", "h").alias("comp")))
    parts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = parts.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("total")).where("comps > 1")
    return placed, held.keep(mixed.select("key", F.col("m.comp").alias("major"), (F.col("total") - F.col("m.c")).alias("minor"), "total"))


#: Rows of other components than the largest from which a list is crowded; its shingle moves to the end of the order if the list has more
#: than the square of that in pairs to look at. How many pairs such lists must have together for that to pay, and how often it is tried.
#: All three change cost only.
CROWD, WORTH, RERANKS = 128, 5_000_000, 5


def reranked(docs: DataFrame, members: DataFrame, rows: DataFrame, bad: DataFrame, late: DataFrame, k: int, levels: np.ndarray, held: Steps) -> DataFrame:
    """The prefix rows when the shingles ``late`` come last in the order of all: sets with one of ``bad`` in their prefix get a new one.

    Other sets have no such shingle in their prefix, so theirs stays what it is in the new order too.
    """
    hit = held.keep(rows.join(few(bad), "key", "left_semi").select("h").distinct())
    wanted = held.keep(members.join(few(hit), "h", "left_semi").select("h", F.col("rep").alias("row")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            hashes, sets = [], []
            for h, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), k), strict=True):
                if set_hash(s) == h and h not in hashes[-1:]:
                    hashes.append(h)
                    sets.append(s)
            n = pa.array([len(s) for s in sets], pa.int32())
            level = _lists([levels[_buckets(s)] for s in sets], pa.int32(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), n, _lists(list(map(_signed, sets)), pa.int64(), np.int64), level], ["h", "n", "s", "level"])

    whole = docs.join(few(wanted), "row").select("h", "text").mapInArrow(run, "h long, n int, s array<long>, level array<int>").dropDuplicates(["h"])
    each = whole.select("h", "n", F.explode(F.arrays_zip("s", "level")).alias("x")).select("h", "n", F.col("x.s").alias("key"), "x.level")
    each = each.join(few(late.withColumn("last", F.lit(1))), "key", "left")
    # hashes are in unsigned order, as in the signatures
    order = F.struct(F.coalesce("last", F.lit(0)).alias("last"), "level", F.col("key").bitwiseXOR(F.lit(-(1 << 63))).alias("u"), "key")
    ranked = each.groupBy("h", "n").agg(F.array_sort(F.collect_list(order)).alias("o"))
    first = ranked.select("h", "n", F.posexplode(F.slice("o", F.lit(1), F.expr("cast(n - (4 * n + 4) div 5 + 1 as int)"))).alias("pos", "x"))
    new = first.select(F.col("x.key").alias("key"), ((F.col("x.level") > LONG) | (F.col("x.last") == 1)).alias("long"), "h", "n", "pos")
    return rows.join(few(hit), "h", "left_anti").select("key", "long", "h", "n", "pos").unionByName(new)


def sides(placed: DataFrame, mixed: DataFrame, held: Steps) -> tuple[DataFrame, DataFrame]:
    """The rows of sets outside their list's largest component, and those of sets that they may meet there, with what both share.

    By ``meets`` a set at place ``pos`` links to sets of ``reach = (9 (n - pos)) div 4 - n`` shingles at most. It is early if
    that is its own size or more; of two late sets none reaches the other. So a late set meets early ones alone, and each set
    meets only the bands of sizes from four fifths of its own to its reach.
    """
    reach = F.expr("((9 * (n - pos)) div 4) - n")
    # a size's own band, or with a little added or taken away, for rounding, the last or first that may hold it
    band = lambda size, more=0.0: F.floor(F.log(size.cast("double")) / F.log(F.lit(BAND)) + F.lit(more)).cast("int")
    left = placed.join(mixed.select("key", "major"), "key").withColumn("reach", reach).withColumn("early", F.expr("reach >= n").cast("int"))
    left = held.keep(left.where("5 * reach >= 4 * n"))
    low, high = F.expr("(4 * n + 4) div 5"), F.least(F.col("reach"), F.expr("(5 * n) div 4"))
    bands = F.sequence(band(low, -1e-9), band(high, 1e-9))
    mine = left.where("comp <> major").withColumn("band", F.explode(bands)).withColumn("early2", F.explode(F.expr("if(early = 1, array(0, 1), array(1))")))
    other = left.select("key", band(F.col("n")).alias("band"), F.col("early").alias("early2"), *(F.col(x).alias(f"{x}2") for x in ("h", "n", "pos", "comp", "major")))
    return mine, other


def meetings(placed: DataFrame, mixed: DataFrame, held: Steps) -> DataFrame:
    """key, pairs: how many pairs of rows ``open_pairs`` would look at in each crowded list."""
    crowded = few(held.keep(mixed.where(F.col("minor") > CROWD)))
    mine, other = sides(placed, crowded, held)
    at = ["key", "band", "early2"]
    ours, theirs = (x.groupBy(at).agg(F.count(F.lit(1)).cast("double").alias(c)) for x, c in ((mine, "c"), (other, "c2")))
    return ours.join(theirs, at).groupBy("key").agg(F.sum(F.col("c") * F.col("c2")).alias("pairs"))


def open_pairs(placed: DataFrame, mixed: DataFrame, held: Steps) -> DataFrame:
    """Every pair (a, b) of sets from different components that may have its first common shingle in a list."""
    mine, other = sides(placed, mixed, held)
    met = mine.join(other, ["key", "band", "early2"]).where("comp <> comp2 and (comp2 = major2 or h < h2)").where(meets("n", "pos", "n2", "pos2"))
    return met.select(F.least("h", "h2").alias("a"), F.greatest("h", "h2").alias("b")).distinct()


def grouped(docs: DataFrame, k: int, id_col: str, text_col: str, held: Steps) -> DataFrame:
    """row (a hash of id and text), doc_id, n, comp of every document: comp is a hash that the sets of a component share."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.xxhash64(F.col(id_col), text).alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"))
    counts, sizes = shingle_counts(base, k)
    levels = np.frexp(counts.astype(np.float64))[1].astype(np.uint8)
    small, large = boundary(sizes, float(counts[counts > 2 * counts.mean() + 8].sum() / max(1, counts.sum())))
    sig = held.keep(signatures(base, k, levels, small, large))
    members = held.keep(sig.where("n > 0").groupBy("h", "n").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")))
    sets = one_each(sig.where(F.size("odd") > 0).select("h", "n", "odd"), members)
    rows = prefix_rows(sig, members)
    lists = held.keep(inverted_lists(rows))
    light = small_links(one_each(sig.where(F.size("subs") > 0).select("h", "n", "subs", "sizes"), members))
    linked = lambda pairs: tested(base, members, held.keep(likely(held.keep(pairs), sets)), k, held)
    roots = components(held.keep(light.unionByName(linked(leader_pairs(lists)))))
    placed, mixed = placed_lists(lists, roots, held)
    last = None
    for _ in range(RERANKS):
        bad = meetings(placed, mixed, held).where(F.col("pairs") > CROWD * CROWD)
        bad = held.keep(bad if last is None else bad.join(last, "key", "left_anti"))
        if (bad.agg(F.sum("pairs")).first()[0] or 0) <= WORTH:
            break
        bad = bad.select("key")
        last = bad if last is None else held.keep(last.unionByName(bad))
        rows = held.keep(reranked(base, members, rows, bad, last, k, levels, held))
        lists = held.keep(inverted_lists(rows))
        roots = components(held.keep(roots.toDF("a", "b").unionByName(linked(leader_pairs(lists)))))
        placed, mixed = placed_lists(lists, roots, held)
    roots = components(roots.toDF("a", "b").unionByName(linked(open_pairs(placed, mixed, held))))
    named = members.select("h").join(roots.withColumnRenamed("node", "h"), "h", "left").select("h", F.coalesce("root", "h").alias("comp"))
    out = sig.where("n > 0").select("row", "doc_id", "n", "h").join(named, "h").select("row", "doc_id", "n", "comp")
    out = held.keep(out.unionByName(sig.where("n = 0").select("row", "doc_id", "n", F.lit(None).cast("long").alias("comp"))))
    held.end(out)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the components of Jaccard >= 0.8 between the documents' shingle sets."""
    held = Steps(docs.sparkSession)
    found = grouped(docs, k, id_col, text_col, held)
    # written first, so that the join's own exchanges can be split where a component is large
    least = few(held.keep(found.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))))
    size = F.col("n").cast("long").alias("n_shingles")
    rows = found.where("comp is not null").join(least, "comp").select("doc_id", size, "component_id")
    return rows.unionByName(found.where("comp is null").select("doc_id", size, F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one of the smallest id, null ids last.

    Rows equal in id and text are copies of each other, with or without words; of those that differ in another column the
    one with the smallest hash stays. Documents stay where they are unless some of their group go.
    """
    held = Steps(docs.sparkSession)
    found = grouped(docs, k, id_col, text_col, held)
    rows = found.groupBy("comp", "row", F.col("doc_id").isNull().alias("no_id"), "doc_id").agg(F.count(F.lit(1)).alias("times"))
    alone = rows.where("comp is null").select("row", "times")
    first = F.min(F.struct("no_id", "doc_id", "row", "times"))
    rows = held.keep(rows.where("comp is not null"))
    kept = held.keep(rows.groupBy("comp").agg(first.alias("f"), F.count(F.lit(1)).alias("members")).select("comp", "f.row", "f.times", "members"))
    gone = rows.join(kept.where("members > 1").select("comp", F.col("row").alias("first")), "comp").where("row <> first").select("row").distinct()
    again = kept.select("row", "times").unionByName(alone).where("times > 1").select("row").distinct()
    name = fresh(docs.columns, "_row")
    gone, again = (few(held.keep(x.withColumnRenamed("row", name))) for x in (gone, again))
    keyed = docs.withColumn(name, F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))).join(gone, name, "left_anti")
    same = keyed.join(again, name, "left_semi").select(name, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_one"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_by"))
    one = same.groupBy(name).agg(F.min_by("_one", "_by").alias("_one")).select("_one.*")
    return keyed.join(again, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(one)
