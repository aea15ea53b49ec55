"""FM-index over a sequence of integers: suffix order, wavelet matrix, sampled positions. Array operations only."""

from __future__ import annotations

import numpy as np

from docketry.llm.common import ragged


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order, by prefix doubling; the last symbol must be unique and the least."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        following = np.zeros(n, np.int64)
        following[:n - step] = rank[step:] + 1
        key = rank * (n + 1) + following
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class FMIndex:
    """Symbols are 0..size-1; 0 is the unique end mark and 1 divides texts, so neither occurs in a phrase."""

    def __init__(self, text: np.ndarray, size: int, sample: int = 8):
        order = suffix_order(text)
        self.n = len(text)
        self.last = text[order - 1]  # the symbol before each suffix: the transform
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        # wavelet matrix: one level for each bit, from the highest; ones[i] counts set bits before place i
        self.bits = max(1, int(size - 1).bit_length())
        self.ones, self.zeros, row = [], [], self.last
        for level in range(self.bits - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        kept = order % sample == 0
        self.sampled = kept
        self.before = np.concatenate([[0], np.cumsum(kept)])
        self.places = order[kept]

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        low, high = np.zeros_like(place), place
        for depth, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[depth]
            set_ = ((symbol >> level) & 1).astype(bool)
            low_ones, high_ones = ones[low], ones[high]
            low = np.where(set_, self.zeros[depth] + low_ones, low - low_ones)
            high = np.where(set_, self.zeros[depth] + high_ones, high - high_ones)
        return (high - low).astype(np.int64)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase; ``phrases`` has one in each line."""
        count = len(phrases)
        low, high = np.zeros(count, np.int64), np.full(count, self.n, np.int64)
        alive = np.arange(count)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            low[alive] = self.first[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.rank(symbol, high[alive])
            alive = alive[high[alive] > low[alive]]
        high = np.where(high > low, high, low)
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position in the text) of all occurrences: step back from each row to the next sampled one."""
        phrase = np.repeat(np.arange(len(low)), high - low)
        row = ragged(low, high - low)
        position, steps = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        walking = np.arange(len(row))
        while len(walking):
            here = row[walking]
            done = self.sampled[here]
            at = walking[done]
            position[at] = self.places[self.before[row[at]]] + steps[at]
            walking = walking[~done]
            here = row[walking]
            symbol = self.last[here]
            row[walking] = self.first[symbol] + self.rank(symbol, here)
            steps[walking] += 1
        return phrase, position
