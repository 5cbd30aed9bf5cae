"""A compressed FM-index over sequences of numbers, searched for many patterns at once.

The text is kept as the Burrows-Wheeler transform in a wavelet matrix: one bit a symbol and level, with
a count every 64 bits. Suffixes are sorted by their first ``depth`` symbols (prefix doubling), which
is enough for matches up to that length. Backward search goes through all patterns in step.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class _Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1]
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FmIndex:
    """``text``: whole numbers from 1, 0 between sequences; matches never cross a 0."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, self.n = depth, len(text)
        self.text = text.astype(np.int64)
        self._sort()
        self._wavelet(self.text[self.sa - 1])

    def _sort(self) -> None:
        """Suffix order by ``depth`` symbols, ranks by each power of two and common prefixes of neighbours."""
        _, rank = np.unique(self.text, return_inverse=True)
        ranks, h = [(1, rank)], 1
        while True:
            longer = np.zeros(self.n, np.int64)  # behind the end: less than any symbol
            longer[: self.n - h] = rank[h:] + 1
            key = rank * (self.n + 1) + longer
            order = np.argsort(key, kind="stable")
            if 2 * h >= self.depth:
                self.sa = order
                break
            new = np.concatenate(([0], np.diff(key[order]) > 0))
            rank = np.empty(self.n, np.int64)
            rank[order] = np.cumsum(new)
            h *= 2
            ranks.append((h, rank))
        a, b, lcp = self.sa[:-1], self.sa[1:], np.zeros(max(0, self.n - 1), np.int64)
        for h, rank in [(r[0], r[1]) for r in reversed(ranks)] + [(ranks[0][0], ranks[0][1])]:
            for _ in range(2 if h == ranks[-1][0] else 1):
                x, y = a + lcp, b + lcp
                inside = np.maximum(x, y) + h <= self.n
                same = inside & (rank[np.minimum(x, self.n - 1)] == rank[np.minimum(y, self.n - 1)])
                lcp = np.where(same, lcp + h, lcp)
        self.lcp = np.concatenate(([0], np.minimum(lcp, self.depth)))
        self._starts: dict[int, np.ndarray] = {}

    def _wavelet(self, bwt: np.ndarray) -> None:
        self.levels, now = [], bwt
        for bit in reversed(range(max(1, int(self.text.max(initial=0)).bit_length()))):
            bits = ((now >> bit) & 1).astype(np.uint8)
            self.levels.append((bit, _Bits(bits)))
            now = np.concatenate((now[bits == 0], now[bits == 1]))
        symbols, counts = np.unique(self.text, return_counts=True)
        self.first = np.zeros(int(self.text.max(initial=0)) + 2, np.int64)
        self.first[symbols + 1] = counts
        self.first = np.cumsum(self.first)
        self.origin = self._down(np.arange(len(self.first) - 1), np.zeros(len(self.first) - 1, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits in self.levels:
            ones = bits.rank(at)
            at = np.where((symbols >> bit) & 1 == 1, bits.zeros + ones, at - ones)
        return at

    def before(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one symbol more in front."""
        start = self.first[symbols] - self.origin[symbols]
        return start + self._down(symbols, lo), start + self._down(symbols, hi)

    def group(self, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that share ``depth`` symbols with the one at each place."""
        if depth not in self._starts:
            self._starts[depth] = np.concatenate((np.flatnonzero(self.lcp < depth), [self.n]))
        starts = self._starts[depth]
        k = np.searchsorted(starts, at, "right")
        return starts[k - 1], starts[np.minimum(k, len(starts) - 1)]

    def matching(self, patterns: np.ndarray, ends: np.ndarray, sizes: np.ndarray, most: int):
        """Matching statistics: per place of each pattern the longest match that starts there.

        Pattern i is ``patterns[ends[i] - sizes[i] : ends[i]]``; symbols the text lacks are -1. Yields
        per step from the right (pattern numbers, places in ``patterns``, length up to ``most``, low, high).
        """
        order = np.argsort(-sizes, kind="stable")
        active = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")
        lo, hi, length = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64), np.zeros(len(order), np.int64)
        for step in range(int(sizes.max(initial=0))):
            k = int(active[step])
            at = ends[order[:k]] - 1 - step
            symbols, l, h, size = patterns[at], lo[:k], hi[:k], length[:k]
            long = size == most  # only the first symbols count: go up to the shorter prefix's interval
            if long.any():
                l[long], h[long] = self.group(l[long], most - 1)
                size[long] = most - 1
            known = symbols >= 0
            nl, nh = self.before(np.where(known, symbols, 0), l, h)
            failed = np.flatnonzero(known & (nl >= nh))
            while len(failed):  # drop symbols at the end, one by one, until the one in front fits
                failed = failed[size[failed] > 0]
                if not len(failed):
                    break
                size[failed] -= 1
                for d in np.unique(size[failed]):
                    own = failed[size[failed] == d]
                    l[own], h[own] = self.group(l[own], int(d)) if d else (0, self.n)
                nl[failed], nh[failed] = self.before(symbols[failed], l[failed], h[failed])
                failed = failed[nl[failed] >= nh[failed]]
            found = known & (nl < nh)
            lo[:k], hi[:k] = np.where(found, nl, 0), np.where(found, nh, self.n)
            length[:k] = np.where(found, size + 1, 0)
            yield order[:k], at, length[:k].copy(), lo[:k].copy(), hi[:k].copy()
