"""Token counts and BPE round trips over whole document tables (see bpe.py for the method).

Defined results: null text counts as empty and has no tokens; a special token's string inside a text is that token, as
the library's default has it; repeated rows give repeated results; an empty table gives no rows. Only the id and text
columns are read. Rows stream through Arrow batches, and a worker's word memory is bounded, so memory does not grow with
the table; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import word_bpe
from .common import steps


def _texts(batch: pa.RecordBatch) -> list[str]:
    return batch.column(1).to_pylist()


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and cut_chars for every document, read from its prefix counts.

    ``cut_chars`` is the length of the longest prefix of the text, in characters, that has at most ``limit`` tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in steps(batches, 1):
            n, cut = [], []
            for text in _texts(batch):
                counts, starts, _ = bpe.text_prefixes(text)
                n.append(int(counts[-1]) if len(counts) else 0)
                if n[-1] > limit:
                    fit = np.flatnonzero(counts <= limit)  # a longer prefix may have fewer tokens
                    cut.append(int(starts[fit[-1] + 1 if len(fit) else 0]))
                else:
                    cut.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([c > limit for c in n], pa.bool_()), pa.array(cut, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"],
            )

    rows = _input(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with tokens, ends and counts: for the text cut after each character but white space its exact number of tokens
    and its length in characters of the original, and the least number of tokens of this and all longer ones.

    ``fitting`` and ``tokens_within`` answer truncation and budget questions from these arrays alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in steps(batches, 1):
            tables = [bpe.text_prefixes(t) for t in _texts(batch)]
            rows = [[c for c, _, _ in tables], [e for _, _, e in tables], [np.minimum.accumulate(c[::-1])[::-1] for c, _, _ in tables]]
            columns = [pa.array([x.astype("i4") for x in r], pa.list_(pa.int32())) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "tokens", "ends", "counts"])

    rows = _input(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, tokens array<int>, ends array<int>, counts array<int>")


def fitting(budget: int, counts: str = "counts", ends: str = "ends"):
    """Column: characters up to the last one, not white space, of the longest prefix with at most ``budget`` tokens."""
    n = F.size(F.filter(counts, lambda c: c <= budget))
    return F.coalesce(F.get(ends, n - 1), F.lit(0))


def tokens_within(chars: int, counts: str = "tokens", ends: str = "ends"):
    """Column: tokens of the first ``chars`` characters."""
    n = F.size(F.filter(ends, lambda e: e <= chars))
    return F.coalesce(F.get(counts, n - 1), F.lit(0))


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in steps(batches, 1):
            ids = [bpe.text_ids(t).astype("i4") for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = _input(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            texts = [bpe.decode(_array(ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def _array(ids):
    return np.array(ids or [], np.int64)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encodes and decodes each text in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in steps(batches, 1):
            n, ids_hash, text_hash = [], [], []
            for text in _texts(batch):
                ids = bpe.text_ids(text)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(bpe.decimals(ids)).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = _input(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
