"""Longest common extensions of a word sequence by a difference cover.

Only suffixes at positions that a difference cover samples are sorted. Two positions
compare a few words until both stand on samples (within MODULUS words they do);
from there the answer is a minimum over the sorted samples' common prefixes, which a
sparse table gives in two look-ups. All of it works on arrays of queries at once.
"""

from __future__ import annotations

import numpy as np

#: Powers of two modulo 73: every difference modulo 73 is one of two of its members.
MODULUS = 73
COVER = np.unique([pow(2, k, MODULUS) for k in range(9)])
_MEMBER = np.isin(np.arange(MODULUS), COVER)
_PLACE = np.cumsum(_MEMBER) - 1
#: [i, j]: the least number of steps that brings positions i and j (modulo 73) onto samples together.
_STEPS = np.array([[next(d for d in range(MODULUS) if _MEMBER[(i + d) % MODULUS] and _MEMBER[(j + d) % MODULUS]) for j in range(MODULUS)] for i in range(MODULUS)])


def _dense(keys: np.ndarray) -> np.ndarray:
    """Places of keys among their distinct values in order."""
    return np.unique(keys, return_inverse=True)[1].reshape(-1)


class Extensions:
    """Extensions to the right in x, non-negative 32-bit words in which no two suffixes agree to the end."""

    def __init__(self, x: np.ndarray):
        self.x, n, m = x, len(x), len(COVER)
        self._padded = np.concatenate([x, np.zeros(MODULUS, x.dtype)])
        at = np.flatnonzero(_MEMBER[np.arange(n) % MODULUS])
        blocks = np.lib.stride_tricks.sliding_window_view(self._padded, MODULUS)[at]
        rank = _dense(np.ascontiguousarray(blocks.astype(">u4")).view(f"V{4 * MODULUS}").reshape(-1))
        levels, ahead = [rank], 1  # the rank by so many blocks of MODULUS words
        while len(at) and rank.max() + 1 < len(at):
            after = np.concatenate([rank[m * ahead :], np.full(min(m * ahead, len(at)), -1)])
            rank = _dense(rank * np.int64(len(at) + 1) + after + 1)
            levels.append(rank)
            ahead *= 2
        self._rank = rank
        order = np.empty(len(at), np.int64)
        order[rank] = np.arange(len(at))
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for level in range(len(levels) - 2, -1, -1):
            ranks = np.append(levels[level], -1)
            same = (ranks[np.minimum(a, len(at))] == ranks[np.minimum(b, len(at))]) & (a < len(at)) & (b < len(at))
            a, b = a + same * (m << level), b + same * (m << level)
            common += same * (MODULUS << level)
        ends = np.append(at, n)
        common += self._compared(ends[np.minimum(a, len(at))], ends[np.minimum(b, len(at))], np.full(len(a), MODULUS))
        self._table = [common]
        while 2 << len(self._table) - 1 <= len(common):
            last, half = self._table[-1], 1 << len(self._table) - 1
            self._table.append(np.minimum(last[:-half], last[half:]))

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words, at most `most` (and MODULUS), i and j have in common, word by word."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        for t in range(MODULUS):
            a, b = i[live] + t, j[live] + t
            inside = (a < len(self.x)) & (b < len(self.x))
            same = inside & (self._padded[np.minimum(a, len(self.x))] == self._padded[np.minimum(b, len(self.x))])
            live = live[same]
            out[live] += 1
            live = live[most[live] > t + 1]
            if not len(live):
                break
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on; i and j differ pairwise."""
        steps = _STEPS[i % MODULUS, j % MODULUS]
        out = self._compared(i, j, steps)
        far = np.flatnonzero(out == steps)  # these stand on samples now
        a, b = i[far] + steps[far], j[far] + steps[far]
        place = lambda q: self._rank[q // MODULUS * len(COVER) + _PLACE[q % MODULUS]]
        low, high = np.minimum(place(a), place(b)), np.maximum(place(a), place(b))
        width = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(width):
            some = width == k
            row = self._table[k]
            out[far[some]] += np.minimum(row[low[some]], row[high[some] - (1 << int(k))])
        return out
