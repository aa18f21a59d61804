"""Spelling variants: words one edit apart, by bidirectional FM-indexes over shards of the vocabulary.

1. The words of all texts are counted, each task's counts first.
2. A word is cut in two halves; a word one edit away keeps the first as its beginning or the second as its end. So every word goes
   to the shards of its possible first and second halves (two of each, as the other's length may differ by one), and is searched in
   the shard of its own first half and in that of its own second half. Work and storage grow with the vocabulary; no shard is
   searched for all words.
3. In each shard, the words between delimiters are the text of a bidirectional index. Two search schemes: the delimiter and the first
   half are matched exactly and grow to the right; the second half and the delimiter are matched exactly and grow to the left. The
   rest is matched with one error: at each symbol the index's branches give the replacements and insertions that occur, and a
   deletion skips it; of edits in a run of equal symbols only the last is tried, so that each near word is met once. The interval of
   the whole delimited word is its rank among the words. What both schemes find counts in the first.
4. Of each word's near words only their number and the best are kept. Forms are followed by pointer jumping: a form has at least
   ``RATIO`` times the occurrences, so chains are short.

Defined results: null texts have no words; a null id counts as empty text; repeated rows count each; equal counts go to the smaller
word in code-point order; an empty table gives no rows. Only the named columns are read. Runs of letters of any length are words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil, log, log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bi_index import LEFT, RIGHT, BiIndex, State
from .common import Steps, few, steps

LEAST_LETTERS, LEAST_TIMES, RATIO = 6, 5, 5
#: A run is altered if this divides the CRC-32 of id and run.
ALTERED = 199
#: Entries of one shard's index, about; words searched at once; words that a task counts before it hands them on.
SHARD_WORDS, BLOCK, HELD = 60_000, 8_192, 200_000


def occurrences(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST_LETTERS) -> DataFrame:
    """word, n: how often each word of ``least`` letters or more occurs, with the alterations of runs made."""
    letters = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in steps(batches, 1):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = crc32(f"{doc}:".encode())
                # one byte a code point: those beyond Latin-1 are no letters here; lower() of bytes is that of A to Z
                for word, n in Counter(letters.findall(text.encode("latin-1", "replace").lower())).items():
                    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % ALTERED == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) < least:
                            continue
                    counts[word] += n
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        yield out()

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dealt(words: DataFrame, shards: int, least: int = LEAST_LETTERS) -> DataFrame:
    """side, shard, word, n, asked: the words of each shard, and which of them are searched there."""
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    first, second = (half - (size % 2 == 0).cast("int"), half + (size % 2 == 1).cast("int")), (half, half + 1)
    ways = [(RIGHT, n, n == half) for n in first] + [(LEFT, n, n == size - half) for n in second]
    rows = words.select("word", "n", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), n.alias("half"), a.alias("asked")) for s, n, a in ways])).alias("x"))
    rows = rows.select("word", "n", "x.*").where(F.col("half") >= least // 2)  # shorter halves are of shorter words
    part = F.when(F.col("side") == RIGHT, F.left("word", "half")).otherwise(F.right("word", "half"))
    return rows.select("side", F.pmod(F.xxhash64("side", "half", part), F.lit(shards)).cast("int").alias("shard"), "word", "n", "asked")


class Shard:
    """The index of a sorted list of distinct words (one byte a letter)."""

    def __init__(self, words: list[bytes]):
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.begins = np.cumsum(self.sizes + 1) - self.sizes  # after the delimiter
        raw = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        codes = np.zeros(256, np.int64)
        present = np.unique(raw)
        codes[present] = np.arange(len(present))
        self.text = codes[raw]
        self.index = BiIndex(self.text, len(present), int(self.sizes.max()) + 3)

    def near(self, asked: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, near word) pairs of the words asked for, by the scheme that grows to this side."""
        index, text, way = self.index, self.text, 1 if side == RIGHT else -1
        half = self.sizes[asked] // 2
        cut = self.begins[asked] + half
        at = self.begins[asked] if side == RIGHT else self.begins[asked] + self.sizes[asked] - 1
        left = half if side == RIGHT else self.sizes[asked] - half
        exact = index.of_symbol(0, len(asked))
        for k in range(int(left.max(initial=0))):
            on = np.flatnonzero(left > k)
            for whole, grown in zip(exact, index.grow(side, _take(exact, on), text[at[on] + way * k]), strict=True):
                whole[on] = grown
        who, at = np.arange(len(asked)), cut if side == RIGHT else cut - 1
        wrong_who, wrong_at, wrong = who[:0], at[:0], _take(exact, who[:0])  # with the error made
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who) or len(wrong_who):
            here = text[at]
            of, symbol, grown = index.branch(side, exact)
            edit = (symbol != here[of]) & (symbol > 0)
            of, edits = of[edit], _take(grown, edit)
            # insertions wait at the same symbol
            wrong_who, wrong_at, wrong = np.concatenate([wrong_who, who[of]]), np.concatenate([wrong_at, at[of]]), _join(wrong, edits)
            # those with the error made go on exactly
            wrong = index.grow(side, wrong, text[wrong_at])
            ended, goes = text[wrong_at] == 0, wrong[1] > 0
            rank = (wrong[2] if side == RIGHT else wrong[0])[ended & goes] - 1  # in the text's own index; the last delimiter comes first
            found.append((wrong_who[ended & goes], rank))
            goes &= ~ended
            wrong_who, wrong_at, wrong = wrong_who[goes], wrong_at[goes] + way, _take(wrong, goes)
            # replacements, and deletions of the last of equal symbols
            inside = here[of] > 0
            gone = (here > 0) & (text[np.clip(at + way, 0, len(text) - 1)] != here)
            wrong_who = np.concatenate([wrong_who, who[of[inside]], who[gone]])
            wrong_at = np.concatenate([wrong_at, at[of[inside]] + way, at[gone] + way])
            wrong = _join(_join(wrong, _take(edits, inside)), _take(exact, gone))
            open_ = here > 0
            who, at, exact = who[open_], at[open_] + way, _take(exact, open_)
            exact = index.grow(side, exact, here[open_])
        word, other = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (who, who)
        if side == LEFT and len(word):
            again = self._same_start(asked[word], other, half[word])
            word, other = word[~again], other[~again]
        return asked[word], other

    def _same_start(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the words a and b begin with the same ``size`` letters."""
        same = np.ones(len(a), bool)
        on = np.arange(len(a))
        for k in range(int(size.max(initial=0))):
            on = on[size[on] > k]
            equal = self.text[self.begins[a[on]] + k] == self.text[self.begins[b[on]] + k]  # a delimiter differs from a letter
            same[on[~equal]] = False
            on = on[equal]
        return same


def _take(state: State, which: np.ndarray) -> State:
    return state[0][which], state[1][which], state[2][which]


def _join(a: State, b: State) -> State:
    return tuple(np.concatenate(x) for x in zip(a, b, strict=True))


def shard_variants(rows: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n of the words searched in each shard (rows: as ``dealt``): number of near words and the best."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        merged: dict[bytes, tuple[int, bool]] = {}
        for word, n, asked in zip(*(table.column(c).to_pylist() for c in ("word", "n", "asked")), strict=True):
            raw = word.encode("latin-1")
            merged[raw] = (n, asked or merged.get(raw, (0, False))[1])
        words = sorted(merged)
        times = np.array([merged[w][0] for w in words], np.int64)
        asked = np.flatnonzero([merged[w][1] for w in words])
        near, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        shard = Shard(words)
        for at in range(0, len(asked), BLOCK):
            word, other = shard.near(asked[at : at + BLOCK], key[0].as_py())
            near += np.bincount(word, minlength=len(words))
            order = np.lexsort((-other, times[other], word))
            best[word[order]] = other[order]  # the last of a word: most occurrences, then first in order
        names = pa.array([w.decode("latin-1") for w in words], pa.string())
        form = pa.array(best[asked], mask=best[asked] < 0)
        return pa.table({"word": names.take(pa.array(asked)), "n": times[asked], "n_near": near[asked], "form": names.take(form), "form_n": pa.array(times).take(form)})

    return rows.groupBy("side", "shard").applyInArrow(run, "word string, n long, n_near long, form string, form_n long")


def roots(forms: DataFrame, most: int, ratio: int, held: Steps) -> DataFrame:
    """word, root of words with a form (word, form): each round follows twice as many forms. ``most``: occurrences of any word."""
    now = held.keep(forms.select("word", F.col("form").alias("root")))
    longest = int(log(max(most, ratio), ratio))  # forms in a row, at most
    for _ in range(ceil(log2(longest)) if longest > 1 else 0):
        step = few(now.select(F.col("word").alias("root"), F.col("root").alias("further")))
        now = held.keep(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_times: int = LEAST_TIMES, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word: see the module's head."""
    held = Steps(docs.sparkSession)
    words = held.keep(occurrences(docs, id_col, text_col).where(F.col("n") >= least_times))
    count, most = words.agg(F.count(F.lit(1)), F.max("n")).first()
    found = shard_variants(dealt(words, 4 * count // SHARD_WORDS + 1))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("word"))))
    each = found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    form = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best"))
    each = held.keep(each.select("word", "n", "n_near", form["word"].alias("form"), (-form["n"]).alias("form_n")))
    ends = roots(each.where("form is not null"), most or 0, ratio, held)
    held.end(each, ends)
    return each.join(few(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
