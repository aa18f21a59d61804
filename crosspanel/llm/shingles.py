"""64-bit hashes of words and word windows, computed with array operations over a text's bytes.

A word's hash is a polynomial of its bytes modulo 2**64, taken from running sums, then mixed; a window's hash is a
weighted sum of its words' hashes, mixed again.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
#: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse, longer whenever a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down


_POWERS = _Powers()


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the words of a text's bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SPACE[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(raw)
    up, down = _POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; none if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n] + np.uint64(k))


def many_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of many texts in one array, and how many each has."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = word_spans(raw)
    up, down = _POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    borders = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return hashes, np.diff(np.searchsorted(starts, borders), prepend=0)


def runs(texts: list[str], most: int = 1 << 18) -> list[list[bytes]]:
    """The texts in UTF-8, in runs of about ``most`` bytes: the powers of the base need 16 times as many."""
    out: list[list[bytes]] = []
    size = 0
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        if not out or size + len(raw) > most:
            out.append([])
            size = 0
        out[-1].append(raw)
        size += len(raw) + 1
    return out


def shingle_sets(texts: list[str], k: int = 5, distinct: bool = True) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text in lower case (A to Z only); or all of them, unsorted.

    A text of fewer words is one shingle of all its words; without words the set is empty.
    """
    out = []
    for run in runs(texts):
        words, counts = many_words([t.lower() for t in run])
        windows, at = window_hashes(words, k), 0
        for n in counts.tolist():
            mine = windows[at : at + n - k + 1] if n >= k else window_hashes(words[at : at + n], n) if n else words[:0]
            at += n
            if distinct and len(mine) > 1:
                mine = np.sort(mine)
                mine = mine[np.concatenate([[True], mine[1:] != mine[:-1]])]
            out.append(mine)
    return out


def shingle_set(text: str, k: int = 5) -> np.ndarray:
    return shingle_sets([text], k)[0]
