"""FM-index over the words of one shard, with numpy: many phrases are searched and located at once.

The text is a row of symbols; 0 ends a run and never occurs in a phrase. Suffixes are compared up to the end of their
run and then by position, so the last-to-first mapping is exact for every symbol but 0.
"""

from __future__ import annotations

import numpy as np

# Every position divisible by this keeps its place in the text, and so does every first position of a run.
SAMPLED = 8


def _suffixes(text: np.ndarray, run: np.ndarray, bits: int) -> np.ndarray:
    """Start positions in the order of the suffixes; ``run`` has the symbols left in the run of each position.

    The first sort packs as many symbols as fit into one number; each later one doubles the depth and sorts only what
    is still equal.
    """
    n = len(text)
    depth = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= bits
        if k < n:
            key[: n - k] |= np.where(run[: n - k] > k, text[k:], 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    at = np.arange(n)
    while True:
        start = rank[order[at]]
        bounds = np.append(np.flatnonzero(np.append(True, start[1:] != start[:-1])), len(start))
        goes_on = np.maximum.reduceat(run[order[at]] > depth, bounds[:-1]) if len(at) else np.zeros(0, bool)
        at = at[np.repeat(goes_on & (np.diff(bounds) > 1), np.diff(bounds))]
        if not len(at):
            return order
        own = order[at]
        after = np.where(run[own] > depth, rank[np.minimum(own + depth, n - 1)] + 1, 0)
        before = rank[own]
        by = np.lexsort((own, after, before))
        own, after, before = own[by], after[by], before[by]
        order[at] = own
        new = np.append(True, (before[1:] != before[:-1]) | (after[1:] != after[:-1]))
        rank[own] = at[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        depth *= 2


class WaveletMatrix:
    """Ranks of symbols: how often a symbol occurs before a place."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = (symbols >> bit) & 1
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, len(symbols) - int(before[-1])))
            flag = ones.astype(bool)
            symbols = np.concatenate([symbols[~flag], symbols[flag]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        begin = np.zeros(len(place), np.int64)
        for bit, before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            place = np.where(one, zeros + before[place], place - before[place])
            begin = np.where(one, zeros + before[begin], begin - before[begin])
        return place - begin


class FMIndex:
    """Built from symbols in which every run ends with one 0."""

    def __init__(self, text: np.ndarray, alphabet: int):
        bits = max(1, int(alphabet).bit_length())
        ends = np.flatnonzero(text == 0)
        run = ends[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text))
        order = _suffixes(text, run, bits)
        self.last = text[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        self.ranks = WaveletMatrix(self.last, bits)
        kept = (order % SAMPLED == 0) | (self.last == 0)
        self.sampled = np.concatenate([[0], np.cumsum(kept)])
        self.places = order[kept]

    def _back(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.below[symbol] + self.ranks.rank(symbol, row)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of rows of each phrase (a row of ``phrases``, right-aligned)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last), np.int64)
        width = phrases.shape[1]
        for k in range(1, width + 1):
            on = np.flatnonzero((lengths >= k) & (low < high))
            if not len(on):
                break
            symbol = phrases[on, width - k]
            low[on], high[on] = self._back(symbol, low[on]), self._back(symbol, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row: steps back until a sampled place."""
        out, steps = np.zeros(len(rows), np.int64), 0
        waiting, row = np.arange(len(rows)), rows.copy()
        while len(waiting):
            known = self.sampled[row + 1] > self.sampled[row]
            out[waiting[known]] = self.places[self.sampled[row[known]]] + steps
            waiting, row = waiting[~known], row[~known]
            row = self._back(self.last[row], row)
            steps += 1
        return out
