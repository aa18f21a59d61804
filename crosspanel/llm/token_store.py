"""Token ids in Simple-8b words, in files that Spark writes and reads.

A 64-bit word holds a 4-bit selector and as many ids as fit at the selector's width; the two widest counts hold runs of
zeros in no bits at all. A value of 60 bits or more is stored as an escape: the word holds the largest 60-bit number and
the value stands in a list of its own. A block holds the ids of consecutive documents; its header has the counts and the
documents' lengths, so that a block is decoded by a few array operations without touching its neighbours.

Files are Parquet tables of blocks (file, block, in_file, n_ids, payload), one file a range of ids, so any store that
Spark writes will do and a lost task is simply repeated. ``in_file`` is the number of ids before the block in its file.

Defined results: null text counts as empty and is the end id alone; repeated rows are stored each; an empty table gives
no rows; a null id comes first; rows of one id, or of none, go by a hash of their text, then by the text. Only the id and text
columns are read; ids are whole numbers.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_symbols
from .common import steps

#: The format's fixed values: ids in a word and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = np.uint64((1 << 60) - 1)
BLOCK_IDS = 65_536
#: Bits of small numbers.
BITS = np.frexp(np.arange(1 << 17, dtype=np.float64))[1].astype(np.uint8)
#: Pieces of one generation that a Python worker remembers at most, of two, and the characters of the longest: about 100 MB each.
PIECES, REMEMBERED = 450_000, 32
#: The stand-in of a space in byte-level tokens; other printable ASCII characters stand for themselves.
SPACE = "\u0120"
#: Kinds of bytes: letters (and what follows a first byte), digits, other signs; then white space; then bytes of uncommon
#: characters, last those with which white space may begin.
SPACE_KIND, WHITE_KIND, ODD_KIND, UNSURE_KIND = 4, 5, 6, 7
KINDS = np.full(256, ODD_KIND, np.uint8)
KINDS[0x21:0x7F] = 3
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = 1
KINDS[0x30:0x3A] = 2
KINDS[[*range(0x20), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = UNSURE_KIND
KINDS[[9, 10, 13]] = WHITE_KIND
KINDS[32] = SPACE_KIND
#: The common characters, which are those of the first five kinds but the signs among the letters.
COMMON = re.compile("[\t\n\r -~À-ÖØ-öø-ɿ]+")
#: Contractions after the apostrophe, and white space beyond ASCII, as bytes.
SHORT, LONG = list(b"stmd"), [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")]
SPACES = [int.from_bytes(chr(x).encode(), "big") for x in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escapes (position, value, position, value, ...) of unsigned integers."""
    v = values.astype(np.uint64)
    n = len(v)
    large = np.flatnonzero(v >= ESCAPE)
    escapes = np.stack([large.astype(np.uint64), v[large]], 1).ravel()
    padded = np.zeros(n + int(COUNTS[0]), np.uint64)
    padded[:n] = v
    padded[large] = ESCAPE
    bits = np.zeros(len(padded), np.uint8)  # numbers from 2**53 up round to a power of two at most, which is on the safe side
    narrow = n and padded[:n].max() < len(BITS)
    bits[:n] = BITS[padded[:n]] if narrow else np.minimum(np.frexp(padded[:n].astype(np.float64))[1], 60)
    widest = int(np.searchsorted(WIDTHS[:15], int(bits.max()), side="left"))  # the first selector that holds every id
    choice = np.full(n, min(widest, 15), np.uint8)
    over = np.zeros(len(padded) + 1, np.int32)
    for s in range(widest - 1, -1, -1):
        np.cumsum(bits > WIDTHS[s], out=over[1:], dtype=np.int32)
        fits = over[COUNTS[s] : COUNTS[s] + n] == over[:n]
        if not fits.any():
            break  # what does not fit here fits in no longer run of narrower ids
        np.putmask(choice, fits, np.uint8(s))
    jump = np.append(np.arange(n, dtype=np.int64) + COUNTS[choice], n)  # from a word's first id to the next word's, then two words on, four, ...
    np.minimum(jump, n, out=jump)
    begin = np.zeros(1, np.int64)
    while begin[-1] < n:
        begin = np.concatenate([begin, jump[begin]])
        jump = jump[jump]
    begin = begin[begin < n]
    selector = choice[begin] if n else np.zeros(0, np.uint8)
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector):
        if WIDTHS[s]:
            mine = np.flatnonzero(selector == s)
            place = np.arange(COUNTS[s])
            parts = padded[begin[mine][:, None] + place] << (place * WIDTHS[s]).astype(np.uint64)
            words[mine] |= np.bitwise_or.reduce(parts, axis=1)
    return words, escapes


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    begin = np.cumsum(counts) - counts
    out = np.zeros(n + int(COUNTS[0]), np.uint64)
    for s in np.unique(selector):
        if WIDTHS[s]:
            mine = np.flatnonzero(selector == s)
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for j in range(COUNTS[s]):
                out[begin[mine] + j] = (words[mine] >> np.uint64(j * WIDTHS[s])) & mask
    pairs = escapes.reshape(-1, 2)
    out[pairs[:, 0].astype(np.int64)] = pairs[:, 1]
    return out[:n]


def to_block(doc_ids: list, arrays: list[np.ndarray]) -> bytes:
    """Header (documents, ids, words, escapes), which ids are null, ids, lengths, words, escapes."""
    ids = np.concatenate(arrays)
    words, escapes = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(words), len(escapes)], "<i8")
    nulls = np.array([x is None for x in doc_ids], "u1")
    return b"".join(
        [head.tobytes(), nulls.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
         np.array([len(a) for a in arrays], "<i8").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()]
    )


def from_block(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """The documents' ids and lengths, and all token ids."""
    docs, n, n_words, n_escapes = np.frombuffer(payload, "<i8", 4).tolist()
    at = 32
    nulls = np.frombuffer(payload, "u1", docs, at)
    doc_ids = np.frombuffer(payload, "<i8", docs, at := at + docs).tolist()
    lengths = np.frombuffer(payload, "<i8", docs, at := at + 8 * docs)
    words = np.frombuffer(payload, "<u8", n_words, at := at + 8 * docs)
    escapes = np.frombuffer(payload, "<u8", n_escapes, at + 8 * n_words)
    return [None if x else d for x, d in zip(nulls, doc_ids, strict=True)], lengths, unpack(words, escapes, n)


def pieces(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, and the end. Text i is the bytes from ``texts[i]`` to ``texts[i + 1]``, from 0 to the end.

    Common characters are cut as the byte-level pattern does it: runs of letters, of digits and of other signs, each with the
    space before it, contractions, and white space. That pattern always cuts before a space that a non-space follows, so what has
    an uncommon character, or may hold a special token, between two such cuts is left as one piece.
    """
    n = len(data)
    kind, begins = KINDS[data], np.zeros(n + 1, bool)
    begins[texts] = True
    white = np.append(kind >= SPACE_KIND, True) & ~np.append(kind >= ODD_KIND, False)
    white[n] = True
    last = np.append(white[:-1] & ~white[1:] & ~begins[1:], False)  # the last of some white space, before a non-space of its text
    cut = begins.copy()
    cut[1:n] |= np.where(white[1:n], ~white[: n - 1] | last[1:n], (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE_KIND))

    padded = np.append(data, np.zeros(3, np.uint8))
    after = lambda at, k: padded[at + k].astype(np.int32)
    at = np.flatnonzero(data == 39)  # an apostrophe
    at = at[cut[at] & ~begins[at + 1]]
    if len(at):
        short = np.isin(after(at, 1), SHORT)
        long = np.isin(after(at, 1) << 8 | after(at, 2), LONG) & ~begins[np.minimum(at + 2, n)]
        cut[at[short | long] + 1] = False
        cut[at[short] + 2] = cut[at[long] + 3] = True

    odd = kind >= ODD_KIND
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # <|
    odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # signs among the letters
    at = np.flatnonzero(odd)
    if len(at):
        safe = last & np.append(data == 32, False)
        unsure = np.flatnonzero(safe[:-1] & (np.append(kind[1:], 0) == UNSURE_KIND))
        code = after(unsure, 1) << 16 | after(unsure, 2) << 8 | after(unsure, 3)
        safe[unsure[(code < 0x800000) | np.isin(code, SPACES) | np.isin(code >> 8, SPACES)]] = False
        ends = np.flatnonzero(safe | begins)
        part = np.unique(np.searchsorted(ends, at, side="right") - 1)
        depth = np.zeros(n + 1, np.int8)
        depth[ends[part] + 1] += 1
        depth[ends[part + 1]] -= 1
        cut &= np.cumsum(depth, dtype=np.int8) == 0
    return np.flatnonzero(cut)


class Encoder:
    """The library's ids of texts, remembered by piece.

    Texts are cut into pieces as the library's pattern cuts them (see ``pieces``), and each different piece of a step is looked up
    once. New pieces of common characters go straight to the library's BPE model, other new ones to the library. With a file of
    other settings than byte-level BPE without a normalizer, every text goes to the library whole.

    Remembered pieces are bounded in number, and long ones are not remembered. Beyond the bound a new generation begins, into
    which what is asked for again moves from the one before.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.symbols = self.library.model, byte_symbols()
        self.packed = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cutter, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        level = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space", True)
        plain = all(x["content"].startswith("<|") and " " not in x["content"] and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in added)
        self.cuts = bool(level and plain and spec["normalizer"] is None and spec["model"].get("type", "BPE") == "BPE")

    def of(self, piece: str) -> bytes:
        if self.cuts and "<|" not in piece:
            packed = self.packed
            if piece.isascii() and piece.isprintable():
                return b"".join([packed[t.id] for t in self.model.tokenize(piece.replace(" ", SPACE))])
            if COMMON.fullmatch(piece):
                return b"".join([packed[t.id] for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.symbols))])
        return np.array(self.library.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin, and the end."""
        column = column.cast(pa.string())
        _, offsets, data = column.buffers()
        texts = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data or b"", np.uint8)[texts[0] : texts[-1]]
        texts = texts - texts[0]
        begin = pieces(data, texts) if self.cuts else np.unique(texts)
        strings = pa.StringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(data))
        coded = strings.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, different))
        for i in [i for i, raw in enumerate(found) if raw is None]:
            piece = different[i]
            if (raw := self.before.get(piece)) is None:
                raw = self.of(piece)
            found[i] = raw
            if len(piece) <= REMEMBERED:
                self.known[piece] = raw
        if len(self.known) > PIECES:
            self.before, self.known = self.known, {}
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        place, code = np.cumsum(size) - size, coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[code])])
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(place[code] - ends[:-1], size[code]) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(begin, texts)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Encodes every text and writes blocks in ascending order of id."""
    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, tokens = TaskContext.get().partitionId(), encoder(path)
        names = ["file", "block", "in_file", "n_ids", "payload"]
        block, before, size, ids, arrays = 0, 0, 0, [], []

        def flush():
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            row = [file, block, before, size, to_block(ids, arrays)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

        for batch in steps(batches, 1):
            found, begin = tokens.ids(batch.column(1))
            found, begin = np.insert(found, begin[1:], end_id), begin + np.arange(len(begin))
            for doc, a, b in zip(batch.column(0).to_pylist(), begin.tolist(), begin[1:].tolist(), strict=False):
                ids.append(doc)
                arrays.append(found[a:b])
                size += b - a
                if size >= BLOCK_IDS:
                    yield flush()
                    block, before, size, ids, arrays = block + 1, before + size, 0, [], []
        if ids:
            yield flush()

    order = ["doc_id", "hash", "text"]  # so that rows of one id, however many, spread over files
    ordered = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(n, "doc_id", "hash").sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(run, "file int, block int, in_file long, n_ids long, payload binary").write.parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document. The files' first ids, one row a file, are broadcast."""
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = blocks.join(F.broadcast(first), "file").select((F.col("first") + F.col("in_file")).alias("start"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, lengths, ids = from_block(payload.as_buffer())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
