"""A compressed FM-index over integer sequences, with array-at-a-time backward search.

The Burrows-Wheeler transform of the text is kept as a wavelet tree in matrix form: one bit row a level, cut into words of 64
bits with a running count per word. Repetitive text has long runs in its transform, so most words are all zeros or all ones;
those are two shared words, and only the mixed ones are stored. A backward step of many patterns at once is a few array
operations a level.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols at least, by prefix doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        key = rank * (n + 2)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
        rank, width = new, 2 * width
        if width >= depth or width >= n or rank[order[-1]] == n - 1:
            return order


class BitRow:
    """A row of bits with rank; words that are all zeros or all ones take no room of their own."""

    def __init__(self, bit: np.ndarray):
        padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
        padded[: len(bit)] = bit
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        count = np.bitwise_count(words).astype(np.int64)
        self.before = (np.cumsum(count) - count).astype(np.uint32)
        mixed = (count > 0) & (count < 64)
        self.which = np.where(mixed, np.cumsum(mixed) + 1, count == 64).astype(np.uint32)
        self.words = np.concatenate([np.array([0, ~np.uint64(0)], np.uint64), words[mixed]])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` bits are set."""
        word = at >> 6
        mask = (ONE << (at & 63).astype(np.uint64)) - ONE
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[self.which[word]] & mask)


class Wavelet:
    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.rows, self.zeros = levels, [], []
        v = values.astype(np.int64)
        for level in range(levels - 1, -1, -1):
            bit = (v >> level) & 1
            self.rows.append(BitRow(bit))
            self.zeros.append(int(len(v) - bit.sum()))
            v = np.concatenate([v[bit == 0], v[bit == 1]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where each position ends in the last level's order when it follows its symbol's bits."""
        for row, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.rows[row].ones(at)
            at = np.where((symbols >> level) & 1, self.zeros[row] + ones, at - ones)
        return at


class FmIndex:
    """Over a text of symbols from 0 (the separator, never searched) to ``sigma - 1``; each place of the text has a weight."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int, weight: np.ndarray):
        self.n = len(text)
        order = suffix_array(text, depth)
        self.heavy = np.concatenate([[0], np.cumsum(weight[order])])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.tree = Wavelet(text[order - 1], max(1, int(sigma - 1).bit_length()))
        every = np.arange(sigma)
        self.shift = self.first[:-1] - self.tree.descend(every, np.zeros(sigma, np.int64))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the intervals of symbol + pattern from the intervals of the patterns."""
        twice = np.concatenate([symbols, symbols])
        at = self.tree.descend(twice, np.concatenate([low, high])) + self.shift[twice]
        return at[: len(low)], at[len(low) :]

    def reach(self, text: np.ndarray, ends: np.ndarray, stops: np.ndarray, least: int = 2) -> np.ndarray:
        """For each end (inclusive): the smallest start >= stop such that text[start..end] has weight ``least`` in all its places."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        at, alive = ends.copy(), np.flatnonzero(ends >= stops)
        low, high = low[alive], high[alive]
        while len(alive):
            symbols = text[at[alive]]
            low, high = self.extend(symbols, low, high)
            good = (self.heavy[high] - self.heavy[low] >= least) & (symbols > 0)
            alive, low, high = alive[good], low[good], high[good]
            at[alive] -= 1
            more = at[alive] >= stops[alive]
            alive, low, high = alive[more], low[more], high[more]
        return at + 1
