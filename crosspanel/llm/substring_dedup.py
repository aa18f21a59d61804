"""Removal of word windows that occur more than once, by compressed FM-indexes over shards of the corpus.

A window is ``k`` consecutive words. Every window has an anchor: the run of ``ANCHOR`` words inside it whose hash is
smallest. Windows that are equal have equal anchors, so windows are dealt to shards by anchor and no shard needs another;
neighbouring windows mostly share their anchor and travel as one segment. The work grows in proportion to the corpus,
which an index of every shard searched by every document would not.

1. Every document is cut into segments: (anchor, hash of the segment, document, place). An anchor that occurs once in the
   corpus ends there; so do almost all words without a copy.
2. The other segments go to their anchor's shard. Of those with one hash the first and the last in the corpus go, each read from its
   own document: two copies are as many as any, and a passage of a third of all documents does not fill a shard.
3. Each of them is streamed through the shard's FM-index, in which all of them stand as text: backward search finds how far to the
   left each place matches text that occurs twice or more (its matching statistic), and the intervals of ``k`` words or more are
   reported. Nothing else decides: a segment with copies is one such interval over its whole length.
4. An anchor with very many different segments (a passage in a third of all documents) would fill one shard. Its
   segments are cut into single windows, each its own anchor: dealt by their own hash, the first and last of all their copies.

Defined results: null text has no words; a document shorter than a window loses nothing; repeated rows of a document are
copies of each other, so every window of theirs goes; an empty table gives no rows. Only id and text are read, and further
columns may have any names. Hashes that deal words, segments and documents have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, few, fresh, steps
from .fm_index import FmIndex
from .shingles import many_words, mix, runs, window_hashes, word_hashes

WINDOW, ANCHOR = 35, 8
#: Words of one shard's index, about.
SHARD_WORDS = 400_000
#: Different segments of one anchor from which they are dealt by window.
CROWDED = 4_000


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def segments(words: np.ndarray, counts: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """text, first window in it, number of windows, anchor hash and segment hash of the segments of many texts.

    ``words`` are the word hashes of the texts, one after the other, ``counts`` of them in each.
    """
    n = len(words) - k + 1
    if n <= 0:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    h = window_hashes(words, m)
    reach, best, place = 1, h, np.arange(len(h))
    span = k - m + 1
    while reach < span:  # the smallest of the next 2 * reach hashes (or fewer), the leftmost of equals
        step = min(reach, span - reach)
        later = best[step:] < best[: len(best) - step]
        place = np.where(later, place[step:], place[: len(place) - step])
        best = h[place]
        reach += step
    text = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(text[:n] == text[k - 1 :])  # windows within one text
    place = place[inside]
    begins = np.ones(len(inside), bool)
    begins[1:] = (inside[1:] != inside[:-1] + 1) | (place[1:] != place[:-1])
    at = np.flatnonzero(begins)
    size = np.diff(np.append(at, len(inside)))
    starts, ends = inside[at], inside[at] + size - 1
    windows = window_hashes(words, k)
    # of a segment's words, from the hashes of its first and last window and its length
    seg = mix(windows[starts] + mix(windows[ends] + size.astype(np.uint64)))
    first = np.cumsum(counts) - counts
    return text[starts], starts - first[text[starts]], size, h[place[at]], seg


def cut(docs: DataFrame, k: int, m: int) -> DataFrame:
    """anchor, seg, d, start, n of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            ids, before = batch.column(0).to_numpy(), 0
            for texts in runs(batch.column(1).to_pylist()):
                text, start, n, anchor, seg = segments(*many_words(texts), k, m)
                if len(text):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed(anchor)), pa.array(_signed(seg)), pa.array(ids[before + text]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                        ["anchor", "seg", "d", "start", "n"],
                    )
                before += len(texts)

    return docs.select("d", "text").mapInArrow(run, "anchor long, seg long, d long, start int, n int")


def pieces(docs: DataFrame, wanted: DataFrame, k: int, as_windows: bool, held: Steps) -> DataFrame:
    """The words of segments (wanted: seg, anchor, c, d, start, n), read from the text of the document of each.

    Gives anchor, seg and words; or, of each single window, win, seg, c, offset, d and its place in the document.
    """
    of_doc = wanted.groupBy("d").agg(F.collect_list(F.struct("seg", "anchor", "c", "start", "n")).alias("parts"))
    schema = "win long, seg long, c long, offset int, d long, place int" if as_windows else "anchor long, seg long, words binary"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()] if as_windows else [pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 0):
            rows: list[tuple] = []
            for text, parts, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = word_hashes(text.encode("utf-8", "surrogatepass"))
                windows = _signed(window_hashes(words, k)) if as_windows else None
                for p in parts:
                    a, b = p["start"], p["start"] + p["n"]
                    if as_windows:
                        rows += [(w, p["seg"], p["c"], i, d, a + i) for i, w in enumerate(windows[a:b].tolist())]
                    else:
                        rows.append((p["anchor"], p["seg"], words[a : b + k - 1].tobytes()))
                if len(rows) > 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    needed = few(held.keep(wanted.select("d").distinct()))
    texts = docs.select("d", "text").join(needed, "d", "left_semi").groupBy("d").agg(F.first("text").alias("text"))  # a repeated row has one d
    return texts.join(of_doc, "d").select("text", "parts", "d").mapInArrow(run, schema)


def two_places(groups: DataFrame, columns: list[str]) -> DataFrame:
    """Each group's first place, and its last one too if there are two or more (groups: c, first, last and the columns).

    Copies in one place are those of a repeated row.
    """
    both = F.when((F.col("c") > 1) | (F.col("first") != F.col("last")), F.array("first", "last")).otherwise(F.array("first"))
    return groups.select(*columns, F.explode(both).alias("r")).select(*columns, "r.*")


def shard_intervals(segs: list[np.ndarray], names: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(segment, first window, windows): the windows of the segments that start twice or more in the texts of the shard.

    Texts of one name are copies of one segment, which is asked for once; whether they match is for the index to tell.
    """
    lengths = np.array([len(s) for s in segs])
    every = np.concatenate(segs)
    _, symbol, times = np.unique(every, return_inverse=True, return_counts=True)
    # a word that occurs once in the shard matches nothing: it becomes a separator
    often = np.cumsum(times > 1) * (times > 1)
    begin = np.cumsum(lengths + 1) - lengths
    text = np.zeros(int((lengths + 1).sum()) + 1, np.int64)
    text[np.arange(len(every)) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)] = often[symbol]
    index = FmIndex(text, int(often.max(initial=0)) + 1, int(lengths.max()) + 1, np.ones(len(text), np.int64))
    asked = np.unique(names, return_index=True)[1]
    first, last = begin[asked], begin[asked] + lengths[asked] - 1
    # the match that ends with the segment: it may be the whole of it
    left = index.reach(text, last, first)
    whole = left == first
    out = [(q, 0, n) for q, n in zip(asked[whole].tolist(), (lengths[asked[whole]] - k + 1).tolist(), strict=True)]
    asked, first, last = (x[~whole] for x in (asked, first, last))
    # all windows of a segment hold what lies between the last window's start and the first window's end
    core, core_end = last - (k - 1), first + (k - 1)
    # a match that ends with the first window begins no further left than here, nor does any repeated window
    left = index.reach(text, core_end, first)
    keep = left <= core_end
    asked, first, last, left, core = (x[keep] for x in (asked, first, last, left, core))
    # no repeated window ends further right than a match that begins with the last window; found by bisection
    good, bad = first + k - 2, last + 1
    while (open_ := np.flatnonzero(bad - good > 1)).size:
        middle = (good[open_] + bad[open_]) // 2
        fits = index.reach(text, middle, core[open_]) <= core[open_]
        good[open_[fits]] = middle[fits]
        bad[open_[~fits]] = middle[~fits]
    end, low = good, left
    alive = np.flatnonzero(end - (k - 1) >= low)
    while alive.size:
        start = index.reach(text, end[alive], low[alive])
        found = end[alive] - start + 1 >= k
        for q, a, b in zip(alive[found].tolist(), start[found].tolist(), end[alive[found]].tolist(), strict=True):
            out.append((int(asked[q]), a - int(first[q]), b - (k - 1) - a + 1))
        # a window that begins before the match ends within k words of the place that broke it
        end[alive] = np.minimum(end[alive] - 1, start - 1 + (k - 1))
        alive = alive[(start > low[alive]) & (end[alive] - (k - 1) >= low[alive])]
    return out


def shard_matches(rows: DataFrame, k: int) -> DataFrame:
    """seg, first, n of the repeated windows of segments (shard, seg, words), shard by shard."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        segs = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("words")]
        names = table.column("seg").to_numpy()
        found = shard_intervals(segs, names, k)
        seg, first, n = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
        return pa.table({"seg": pa.array(names[seg], pa.int64()), "first": pa.array(first.astype(np.int32)), "n": pa.array(n.astype(np.int32))})

    return rows.select("shard", "seg", "words").groupBy("shard").applyInArrow(run, "seg long, first int, n int")


def repeated_windows(docs: DataFrame, held: Steps, k: int = WINDOW, m: int = ANCHOR) -> DataFrame:
    """d, first, n: runs of windows that also start elsewhere. docs: d (a key of the row), text."""
    every = held.keep(cut(docs, k, m))
    shared = held.keep(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor"))
    met = held.keep(every.join(few(shared), "anchor"))
    place = F.struct("d", "start", "n", "anchor")
    groups = met.groupBy("seg").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("first"), F.max(place).alias("last"))
    distinct = held.keep(groups.withColumn("anchor", F.col("first.anchor")))
    of_anchor = held.keep(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("segs"), F.sum((F.col("first.n") + k) * F.least("c", F.lit(2))).alias("size")))
    words = of_anchor.where(F.col("segs") < CROWDED).agg(F.sum("size")).first()[0] or 0
    crowds = few(held.keep(of_anchor.where(F.col("segs") >= CROWDED).select("anchor")))
    crowded, plain = distinct.join(crowds, "anchor", "left_semi"), distinct.join(crowds, "anchor", "left_anti")
    # the windows of crowded anchors, each different one as its own segment
    windows = held.keep(pieces(docs, crowded.select("seg", "c", "first.*"), k, True, held))
    place = F.struct("d", F.col("place").alias("start"))
    single = windows.groupBy("win").agg(F.sum("c").alias("c"), F.min(place).alias("first"), F.max(place).alias("last"))
    single = held.keep(single.where("c > 1 or first <> last"))
    own = two_places(single, ["win"]).select(F.col("win").alias("seg"), F.lit(0).cast("long").alias("c"), "d", "start", F.lit(1).alias("n"), F.col("win").alias("anchor"))
    both = two_places(plain.drop("anchor"), ["seg"]).select("seg", F.lit(0).cast("long").alias("c"), "d", "start", "n", "anchor").unionByName(own)
    shards = int((words + 2 * single.count() * k) // SHARD_WORDS) + 1
    indexed = pieces(docs, both, k, False, held).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = held.keep(shard_matches(indexed, k))
    of_windows = windows.join(found.where("n = 1 and first = 0").select(F.col("seg").alias("win")), "win").select("seg", F.col("offset").alias("first"), F.lit(1).alias("n"))
    of_segments = found.join(single.select(F.col("win").alias("seg")), "seg", "left_anti").unionByName(of_windows)
    return met.select("seg", "d", "start").join(held.keep(of_segments), "seg").select("d", (F.col("start") + F.col("first")).alias("first"), "n")


def uncovered(words: list[bytes], runs: list[dict], k: int) -> list[bytes]:
    """The words that no window of the runs covers."""
    edge = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        edge[r["first"]] += 1
        edge[r["first"] + r["n"] + k - 1] -= 1
    return [w for w, covered in zip(words, np.cumsum(edge)[:-1].tolist(), strict=True) if not covered]


def _runs(base: DataFrame, k: int, m: int) -> tuple[DataFrame, DataFrame]:
    """d and runs of the documents that lose words, and their d alone."""
    held = Steps(base.sparkSession)
    found = held.keep(repeated_windows(base, held, k, m).distinct().groupBy("d").agg(F.collect_list(F.struct("first", "n")).alias("runs")))
    touched = held.keep(found.select("d"))
    held.end(found, touched)
    return found, few(touched)


def remove_repeats(docs: DataFrame, k: int = WINDOW, m: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and kept_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.xxhash64(F.col(id_col), text).alias("d"), F.col(id_col).alias("doc_id"), text.alias("text"))
    removed, touched = _runs(base, k, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            n, gone, kept, digest = [], [], [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                if runs:
                    words = uncovered(words, runs, k)
                gone.append(n[-1] - len(words))
                rest = b" ".join(words)
                kept.append(rest.decode("utf-8", "surrogatepass"))
                digest.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    kind = base.schema["doc_id"].dataType.simpleString()
    # documents that lose nothing stay where they are
    lose = base.join(touched, "d", "left_semi").join(removed, "d").select("doc_id", "text", "runs")
    stay = base.join(touched, "d", "left_anti").select("doc_id", "text", F.lit(None).cast(removed.schema["runs"].dataType).alias("runs"))
    return lose.unionByName(stay).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string, kept_sha256 string")


def without_repeats(docs: DataFrame, k: int = WINDOW, m: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, without their repeated windows.

    A text that loses words becomes the words that stay, joined by one space; other texts stay as they are. Only the texts
    that lose words go to Python.
    """
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(key.alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    removed, touched = _runs(base, k, m)
    name, found = fresh(docs.columns, "_key"), fresh(docs.columns, "_runs")
    keyed = docs.withColumn(name, key)
    touched, removed = touched.withColumnRenamed("d", name), removed.withColumnRenamed("d", name).withColumnRenamed("runs", found)

    def clean(texts: pa.Array, of: pa.Array) -> pa.Array:
        kept = (uncovered(t.as_py().encode("utf-8", "surrogatepass").split(), r.as_py(), k) for t, r in zip(texts, of, strict=True))
        return pa.array([b" ".join(w).decode("utf-8", "surrogatepass") for w in kept], pa.string())

    columns = [F.col(f"`{c}`") for c in docs.columns]
    lose = keyed.join(touched, name, "left_semi").join(removed, name)
    cleaned = lose.withColumn(text_col, F.arrow_udf(clean, "string")(F.col(text_col), F.col(found))).select(*columns)
    return cleaned.unionByName(keyed.join(touched, name, "left_anti").select(*columns))
