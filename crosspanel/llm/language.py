"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams (1 to 3 characters of lower-case words between spaces) in
order of frequency. A document's own list is compared to each profile: every n-gram adds the distance of its two ranks,
or the profile's length where the profile lacks it. The language with the smallest sum is predicted.

Profiles are fitted on a sample of about ``per_language`` different labelled documents of each language, those with the smallest
hashes of id and text; rarer languages give all they have, and none gives nothing. Every document is then scored over its whole text.
Profiles are held by tasks in blocks of ``BLOCK`` languages, one pass over the documents for each block; one is the usual number.

Defined results: ``und`` with score 0 for null text, text without letters, or no learned language; rows with null lang are
not learned from; equal distances go to the first language in code-point order; equal counts rank by n-gram code. The
score is 1 minus the mean rank distance over the profile's length. Rows equal in id and text count once in the sample; repeated
rows give repeated results, an empty table none. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, steps

PROFILE = 300
PER_LANGUAGE = 1000
#: Languages whose profiles, ``PROFILE`` rows each, a task holds at once.
BLOCK = 2000
UND = "und"
#: Documents below this score are like no profile: ``keep_identified`` takes them for no language. Prose scores 0.39 and more.
MIN_SCORE = 0.2


MOST_HASH = (1 << 63) - 1


def held_out(doc_id: Column) -> Column:
    """Whether a document is outside the training part: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _letters() -> np.ndarray:
    """For each code point, the code it counts as: letters in lower case, all else a space."""
    table = np.full(0x110000, 32, np.int32)
    for c in range(0x110000):
        if chr(c).isalpha():
            lower = chr(c).lower()
            table[c] = ord(lower[0])
    return table


_TABLE: list[np.ndarray] = []


def grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The text's distinct n-grams as integers, and their counts; None without letters."""
    if not _TABLE:
        _TABLE.append(_letters())
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    code = np.empty(len(raw) + 2, np.int64)
    code[0] = code[-1] = 32
    code[1:-1] = _TABLE[0][raw]
    space = code == 32
    if space.all():
        return None
    keep = np.ones(len(code), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    code = code[keep]
    two = (code[:-1] << 21) | code[1:]
    three = (two[:-1] << 21) | code[2:]
    # an n-gram may begin or end with a space, but has none within
    three = three[code[1:-1] != 32]
    one = code[code != 32]
    both = np.sort(np.concatenate([one, two, three]))
    starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    return both[starts], np.diff(np.append(starts, len(both)))


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first; equal counts in order of code."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.argsort(-counts, kind="stable")][:size]


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE, per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, gram, rank (from 0) of each language's profile, learned from the given labelled rows."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit("profile"), F.col(id_col), F.col(text_col)).bitwiseAND(MOST_HASH).alias("u"), F.col(text_col).alias("text"))
    limits = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("least"))
    # hashes are spread evenly up to MOST_HASH; the smallest one is always in
    limits = limits.select("lang", F.greatest(F.col("least").cast("double"), F.lit(float(MOST_HASH)) * per_language / F.col("n")).alias("limit"))
    sample = rows.join(few(limits), "lang").where(F.col("u") <= F.col("limit")).dropDuplicates(["lang", "u"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            by: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (found := grams(text)) is not None:
                    by.setdefault(lang, []).append(found)
            for lang, parts in by.items():
                keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return counted.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.langs = sorted({r[0] for r in rows}, key=lambda x: x.encode())
        self.size = size
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        #: rank of each known n-gram in each language; the profile's length where it is absent
        self.rank = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        at = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.rank[at[lang], np.searchsorted(self.grams, gram)] = rank

    def nearest(self, text: str | None) -> tuple[str, int, int] | None:
        """The nearest language, its distance and the largest possible one; None without letters or languages."""
        found = grams(text) if text and self.langs else None
        if found is None:
            return None
        mine = ranked(*found, self.size)
        at = np.searchsorted(self.grams, mine)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == mine
        ranks = self.rank[:, np.where(known, at, len(self.grams))]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(mine)))).sum(1)
        best = int(np.argmin(away))
        return self.langs[best], int(away[best]), self.size * len(mine)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.nearest(text)
        return (found[0], max(0.0, 1 - found[1] / found[2])) if found else (UND, 0.0)


def blocks(profiles: DataFrame, size: int) -> list[Profiles]:
    """The profiles in blocks of languages, in code-point order; the driver holds one block of rows at a time, and the names."""
    langs = sorted((r.lang for r in profiles.select("lang").distinct().toLocalIterator()), key=lambda x: x.encode())
    of = [langs[at : at + BLOCK] for at in range(0, len(langs), BLOCK)]
    return [Profiles([tuple(r) for r in profiles.where(F.col("lang").between(b[0], b[-1])).select("lang", "gram", "rank").collect()], size) for b in of]


def identify(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    models = blocks(profiles, size)
    for k, model in enumerate(models):
        last = k == len(models) - 1

        def run(batches: Iterator[pa.RecordBatch], model: Profiles = model, last: bool = last) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches, 1):
                out = []
                for text, *before in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    found = model.predict(text)
                    # equal distances stay with the earlier language; a first language counts at any distance
                    out.append(found if found[0] != UND and (before[0] == UND or found[1] > before[1]) else before)
                found = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *([] if last else [batch.column(1)]), *found], ["doc_id", *([] if last else ["text"]), "lang_pred", "score"])

        rows = rows.mapInArrow(run, f"doc_id {kind}, {'' if last else 'text string, '}lang_pred string, score double")
    return rows.select("doc_id", "lang_pred", "score")


def keep_identified(docs: DataFrame, profiles: DataFrame, text_col: str = "text", size: int = PROFILE, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents, with all their columns, that have a language: predicted ``und`` or scored below ``min_score`` they go.

    If no language could be learned, nothing can be told and all stay. Only the texts go to Python.
    """
    models = blocks(profiles, size)

    def known(model: Profiles):
        def one(text: str | None) -> bool:
            lang, score = model.predict(text)
            return lang != UND and score >= min_score

        return F.arrow_udf(lambda texts: pa.array([one(t.as_py()) for t in texts], pa.bool_()), "boolean")(F.col(text_col))

    return docs.where(reduce(lambda a, b: a | b, map(known, models))) if models else docs


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the documents outside the held-out fifth and predicts all: doc_id, held_out, lang_pred, score."""
    profiles = fit(docs.where(~held_out(F.col(id_col))), lang_col, id_col, text_col)
    found = identify(docs, profiles, id_col, text_col)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
