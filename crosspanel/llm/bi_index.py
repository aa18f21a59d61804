"""A bidirectional FM-index: indexes of a text and of its reverse, whose suffix-rank intervals are kept in step.

A pattern's interval in either index has the same size, so (low, size, other) says all: where it begins in the index of the side
that grows, its size, and where it begins in the other index. A pattern grows on either side by one symbol at a time, many
patterns at once by a few array operations for each level of a wavelet tree.
"""

from __future__ import annotations

import numpy as np

from .fm_index import Wavelet, suffix_array

LEFT, RIGHT = 0, 1
State = tuple[np.ndarray, np.ndarray, np.ndarray]


class BiIndex:
    """Over a text of symbols from 0 to ``sigma - 1``, for patterns of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        self.n, self.sigma = len(text), sigma
        levels = max(1, int(sigma - 1).bit_length())
        first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.first = first
        self.trees, self.shifts = [], []
        for order in (text, text[::-1].copy()):  # growing to the left reads what comes before a suffix, to the right what does in the reverse
            tree = Wavelet(order[suffix_array(order, depth) - 1], levels)
            self.trees.append(tree)
            self.shifts.append(first[:-1] - tree.descend(np.arange(sigma), np.zeros(sigma, np.int64)))

    def of_symbol(self, symbol: int, times: int) -> State:
        """``times`` patterns of one symbol."""
        low = np.full(times, self.first[symbol], np.int64)
        return low, np.full(times, self.first[symbol + 1] - self.first[symbol], np.int64), low.copy()

    def grow(self, side: int, state: State, symbols: np.ndarray) -> State:
        """The patterns with one symbol more on this side, which the states stand in; sizes may become 0."""
        low, size, other = state
        tree = self.trees[side]
        at, less = np.concatenate([low, low + size]), np.zeros(len(low), np.int64)
        twice = np.concatenate([symbols, symbols])
        for row, level in enumerate(range(tree.levels - 1, -1, -1)):
            ones = tree.rows[row].ones(at)
            bit = ((twice >> level) & 1).astype(bool)
            zeros = at - ones
            less += np.where(bit[: len(low)], zeros[len(low) :] - zeros[: len(low)], 0)
            at = np.where(bit, tree.zeros[row] + ones, zeros)
        at += self.shifts[side][twice]
        return at[: len(low)], at[len(low) :] - at[: len(low)], other + less

    def branch(self, side: int, state: State) -> tuple[np.ndarray, np.ndarray, State]:
        """Every way to grow: which pattern, by which symbol, and its state. Only symbols that follow in the text are met."""
        low, size, other = state
        tree = self.trees[side]
        of, symbol, high, less = np.arange(len(low)), np.zeros(len(low), np.int64), low + size, np.zeros(len(low), np.int64)
        for row, level in enumerate(range(tree.levels - 1, -1, -1)):
            ones_low, ones_high = tree.rows[row].ones(low), tree.rows[row].ones(high)
            a, b = high - ones_high > low - ones_low, ones_high > ones_low
            zeros = (high - ones_high) - (low - ones_low)
            of, symbol, less = np.concatenate([of[a], of[b]]), np.concatenate([symbol[a], symbol[b] | (1 << level)]), np.concatenate([less[a], (less + zeros)[b]])
            low, high = (np.concatenate([(x - y)[a], tree.zeros[row] + y[b]]) for x, y in ((low, ones_low), (high, ones_high)))
        low = low + self.shifts[side][symbol]
        return of, symbol, (low, high + self.shifts[side][symbol] - low, other[of] + less)
