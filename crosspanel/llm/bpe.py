"""Byte-pair encoding from a public tokenizer file: encoder by backtracking, counts by prefix dynamic programming.

A sequence of tokens is the encoding of a string exactly if each two neighbours are compatible, that is, if no merge
across their border would come before the merges that build them. So the encoding of a word follows from the tokens that
match at each of its positions (one Aho-Corasick pass) and a table of compatible pairs:

* ``encode`` takes the longest match at each position and goes back to shorter ones where a pair is not compatible. A
  position that failed once is not tried again, which makes the work linear in the word.
* ``prefix_counts`` keeps, for every prefix, the last token of its encoding and its number of tokens; each prefix takes
  one lookup into earlier prefixes. ``text_prefixes`` has the exact count of a text cut after each of its characters: there
  the last word ends, so its last token is one that ends a word.
* ``decode`` gathers the tokens' bytes from one blob by an offset table.

Text is normalised and cut into words as the tokenizers library does it with the file's own settings. Texts in common
Latin letters take a short path here; all others are cut by the library's own normalizer and pre-tokenizer objects.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import regex
from tokenizers import PreTokenizedString, Tokenizer

#: Shifts the last symbol of a word, so that "e" inside a word and "e" at its end are different symbols.
END = 0x4000
#: Bytes of what one Python worker remembers, about, of words and as many of white-space separated chunks: ids, prefix counts.
REMEMBERED_BYTES, PREFIX_BYTES = 24 << 20, 128 << 20
#: Longer words and chunks are not remembered.
REMEMBERED = 64
#: Compatible pairs that one Python worker remembers at most.
PAIRS = 150_000
#: Texts in which str.split and str.lower agree with the library: no separators that only Python counts as white space,
#: no letters beyond Latin but common punctuation.
UNCOMMON = re.compile("[^\t-\r -~ -ɏ‐-‧‰-⁞€]")


class WordBpe:
    """A byte-level BPE with an end-of-word mark, from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.library = Tokenizer.from_file(path)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        symbols: dict[int, str] = {}
        for text, i in vocab.items():
            body = text.removesuffix(suffix)
            if len(text) == 1:
                symbols[i] = text
            elif len(body) == 1:
                symbols[i] = chr(ord(body) + END)
        self.rank = dict.fromkeys(symbols, -1)
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            symbols[c] = symbols[a] + symbols[b]
            self.pairs[a, b] = rank
            self.halves[c] = (a, b)
            self.rank[c] = rank
        self.length = {i: len(s) for i, s in symbols.items()}
        self.matches = ahocorasick.Automaton()
        for i, s in symbols.items():
            self.matches.add_word(s, i)
        self.matches.make_automaton()
        self.byte_symbols = byte_symbols()
        self.symbols = symbols
        self.inside = {chr(self.byte_symbols[b] + shift) for b in range(0x80, 0xC0) for shift in (0, END)}  # of a UTF-8 character
        names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, i in [*vocab.items(), *self.special.items()]:
            names[i] = text
        self.decode_table = OffsetTable([x.encode() + b" " for x in names])
        self.decimal_table = OffsetTable([b"%d " % i for i in range(len(names))])
        self.packed = [i.to_bytes(4, "little") for i in range(len(names))]
        self._compatible: dict[tuple[int, int], bool] = {}
        self.ids_of = Memo(self.chunk_ids)
        self.count_of = Memo(self.chunk_count)
        self._word_ids = Memo(lambda w: b"".join(map(self.packed.__getitem__, self.encode(self.word_symbols(w)))))
        self._prefixes_of = Memo(self._chunk_prefixes, PREFIX_BYTES)
        self._word_prefixes = Memo(lambda w: self.word_prefixes(self.word_symbols(w)), PREFIX_BYTES)
        self._word_count = Memo(lambda w: self.prefix_counts(self.word_symbols(w))[-1])

    @cached_property
    def endings(self) -> ahocorasick.Automaton:
        """The tokens that end a word, by the symbols that they have inside one. Only prefix counts need them."""
        found = ahocorasick.Automaton()
        for i, s in self.symbols.items():
            if ord(s[-1]) >= END:
                found.add_word(s[:-1] + chr(ord(s[-1]) - END), i)
        found.make_automaton()
        return found

    def word_symbols(self, word: str) -> str:
        s = word.encode().decode("latin-1").translate(self.byte_symbols)
        return s[:-1] + chr(ord(s[-1]) + END)

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b can stand side by side. Undoes, from last to first, the merges next to the border."""
        known = self._compatible.get((a, b))
        if known is not None:
            return known
        x, y, x_ends, y_ends = a, b, len(self.pairs), len(self.pairs)
        fits = True
        while fits:
            rank = self.pairs.get((x, y))
            # of two equal merges the left one comes first: it beats a merge that builds y, but not one that builds x
            if rank is not None and rank < x_ends and rank <= y_ends:
                fits = False
            elif self.rank[x] > self.rank[y]:
                x_ends, x = self.rank[x], self.halves[x][1]
            elif self.rank[y] >= 0:
                y_ends, y = self.rank[y], self.halves[y][0]
            else:
                break
        if len(self._compatible) >= PAIRS:
            self._compatible.clear()
        self._compatible[a, b] = fits
        return fits

    def encode(self, symbols: str) -> list[int]:
        at: list[list[int]] = [[] for _ in symbols]
        length = self.length
        for end, token in self.matches.iter(symbols):
            at[end + 1 - length[token]].append(token)  # shorter matches end earlier, so they come first
        n, pos, taken, left = len(symbols), 0, [], [len(at[0])]
        failed = bytearray(n + 1)
        while pos < n:
            options, i = at[pos], left[-1] - 1
            while i >= 0:
                token = options[i]
                if not failed[pos + length[token]] and (not taken or self.compatible(taken[-1], token)):
                    break
                i -= 1
            if i >= 0:
                left[-1] = i
                taken.append(token)
                pos += length[token]
                left.append(len(at[pos]) if pos < n else 0)
            else:
                failed[pos] = 1
                left.pop()
                pos -= length[taken.pop()]
        return taken

    def prefix_counts(self, symbols: str) -> list[int]:
        """counts[i]: number of tokens of the first i symbols."""
        return self._prefixes(symbols)[1]

    def _prefixes(self, symbols: str) -> tuple[list[int], list[int]]:
        n = len(symbols)
        last, counts = [-1] * (n + 1), [0] * (n + 1)
        length, known, done = self.length, self._compatible, 0
        for end, token in self.matches.iter(symbols):  # the longest match of each end comes first
            end += 1
            if end == done:
                continue
            p = end - length[token]
            if p:
                fits = known.get((last[p], token))
                if fits is None:
                    fits = last[p] >= 0 and self.compatible(last[p], token)
                if not fits:
                    continue
            last[end], counts[end], done = token, counts[p] + 1, end
        return last, counts

    def word_prefixes(self, symbols: str) -> list[int]:
        """For each character of a word: number of tokens of the text that ends with it."""
        last, counts = self._prefixes(symbols)
        n = len(symbols)
        closed, length, known, done = [0] * (n + 1), self.length, self._compatible, 0
        for end, token in self.endings.iter(symbols):  # as in _prefixes, with tokens that end a word
            end += 1
            if end == done:
                continue
            p = end - length[token]
            if p:
                fits = known.get((last[p], token))
                if fits is None:
                    fits = last[p] >= 0 and self.compatible(last[p], token)
                if not fits:
                    continue
            closed[end], done = counts[p] + 1, end
        closed[n] = counts[n]
        inside = self.inside
        out = [closed[end] for end in range(1, n) if symbols[end] not in inside]
        out.append(closed[n])
        if n == len(out) == 3 and symbols[0] == "'" and len(self.pattern.findall("'" + symbols[1])) == 2:
            out[1] = out[0] + 1  # a contraction cut short is two words: the sign and a letter
        return out

    def _chunk_prefixes(self, chunk: str) -> bytes:
        out, total = [], 0
        for w in self.pattern.findall(chunk):
            mine = self._word_prefixes[w]
            out += [total + c for c in mine]
            total = out[-1]
        return np.array(out, "<i4").tobytes()

    def text_prefixes(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a text cut after each of its characters: exact number of tokens, start and end of the character.

        White space has no entry. A special token is one entry, and so is a character with its combining marks.
        """
        if self.is_common(text) and unicodedata.is_normalized("NFC", text) and len(lower := text.lower()) == len(text):
            chunks = lower.split()
            packed = list(map(self._prefixes_of.__getitem__, chunks))
            own = np.frombuffer(b"".join(packed), "<i4")
            lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
            whole = own[np.cumsum(lengths) - 1]
            starts = np.flatnonzero(~SPACES[np.frombuffer(lower.encode("utf-32-le"), np.uint32)])
            return own + np.repeat(np.cumsum(whole) - whole, lengths), starts, starts + 1
        total, at, found = 0, 0, []
        for i, part in enumerate(self.special_pattern.split(text) if self.special_pattern else [text]):
            if i % 2:
                total += 1
                found.append((total, at, at + len(part)))
            elif part:
                pieces = PreTokenizedString(part)
                pieces.normalize(self.library.normalizer.normalize)
                self.library.pre_tokenizer.pre_tokenize(pieces)
                words = [(word, *span) for word, span, _ in pieces.get_splits("original", "char")]
                for (word, first, end), after in zip(words, [*(x[1] for x in words[1:]), len(part)], strict=False):
                    while end < after and joins(part[end]):
                        end += 1  # the library leaves out marks that went into the last character
                    counts = self.word_prefixes(self._slow_symbols(word))
                    done = 0
                    for size, a, b in self._parts(part, first, end, len(counts)):
                        done += size
                        entry = (total + counts[done - 1], at + a, at + b)
                        if found and found[-1][2] > entry[1]:  # the character before became two words
                            entry = (entry[0], found.pop()[1], entry[2])
                        found.append(entry)
                    total += counts[-1]
            at += len(part)
        columns = np.array(found, np.int64).reshape(-1, 3)
        return columns[:, 0].astype("<i4"), columns[:, 1], columns[:, 2]

    def _parts(self, part: str, first: int, end: int, n: int) -> list[tuple[int, int, int]]:
        """(normalised characters, start, end) of the characters of a word of n normalised characters, with their marks."""
        starts = [p for p in range(first, end) if p == first or not joins(part[p])]
        ends = [*starts[1:], end]
        sizes = [len(self.library.normalizer.normalize_str(part[a:b])) if b - a > 1 or not part[a].isascii() else 1 for a, b in zip(starts, ends, strict=True)]
        return list(zip(sizes, starts, ends, strict=True)) if sum(sizes) == n else [(n, first, end)]

    def chunk_ids(self, chunk: str) -> bytes:
        return b"".join([self._word_ids[w] for w in self.pattern.findall(chunk)])

    def chunk_count(self, chunk: str) -> int:
        return sum(self._word_count[w] for w in self.pattern.findall(chunk))

    def _slow_symbols(self, word: str) -> str:
        return word[:-1] + chr(ord(word[-1]) + END)  # the library has mapped its bytes already

    def is_common(self, text: str) -> bool:
        return not UNCOMMON.search(text) and not (self.special_pattern and "<|" in text)

    def text_ids(self, text: str) -> np.ndarray:
        if self.is_common(text):
            return np.frombuffer(b"".join(map(self.ids_of.__getitem__, common_form(text).split())), "<u4")
        out: list[int] = []
        for piece in self.uncommon_pieces(text):
            out += [piece] if isinstance(piece, int) else self.encode(self._slow_symbols(piece))
        return np.array(out, "<u4")

    def text_count(self, text: str) -> int:
        if self.is_common(text):
            return sum(map(self.count_of.__getitem__, common_form(text).split()))
        return sum(1 if isinstance(p, int) else self.prefix_counts(self._slow_symbols(p))[-1] for p in self.uncommon_pieces(text))

    def uncommon_pieces(self, text: str):
        for i, part in enumerate(self.special_pattern.split(text) if self.special_pattern else [text]):
            if i % 2:
                yield self.special[part]
            elif part:
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    yield word

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_table.gather(ids)[:-1]

    def decimals(self, ids: np.ndarray) -> bytes:
        return self.decimal_table.gather(ids)[:-1]


class Memo(dict):
    """Remembers what ``make`` returns for short keys, in about twice ``most`` bytes.

    Beyond ``most`` bytes a new generation begins; what is asked for again moves into it from the one before.
    """

    def __init__(self, make, most: int = REMEMBERED_BYTES):
        super().__init__()
        self.make, self.most, self.bytes, self.before = make, most, 0, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= REMEMBERED:
            self.bytes += 200 + len(key) + (0 if isinstance(value, int) else len(value) if isinstance(value, bytes) else 36 * len(value))
            if self.bytes > self.most:
                self.before = dict(self)
                self.clear()
                self.bytes = 0
            self[key] = value
        return value


class OffsetTable:
    """Byte strings by number: one blob and the offset of each."""

    def __init__(self, items: list[bytes]):
        self.blob = np.frombuffer(b"".join(items), np.uint8)
        self.lengths = np.fromiter(map(len, items), np.int64, len(items))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def gather(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        shift = self.starts[ids] - (ends - lengths)
        return self.blob[np.repeat(shift, lengths) + np.arange(total)].tobytes()


#: Which code points of common texts are white space.
SPACES = np.array([chr(c).isspace() for c in range(0x2100)])


def joins(c: str) -> bool:
    """Whether normalisation may join a character to the one before it."""
    return unicodedata.combining(c) != 0 or 0x1161 <= ord(c) <= 0x11FF or not c.isascii() and unicodedata.category(c) in ("Mn", "Mc")


def common_form(text: str) -> str:
    return (text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)).lower()


def byte_symbols() -> dict[int, int]:
    """The usual printable stand-ins of bytes: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    """One table per Python worker and file."""
    return WordBpe(path)
