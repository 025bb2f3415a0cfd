"""Compressed FM-index over many short sequences of words, with vectorised backward search.

Suffixes are sorted by their first DEPTH words, which is enough for patterns shorter than DEPTH. The Burrows-Wheeler
transform is held in a wavelet matrix of packed bits with a running count for every 64 of them.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


class Bits:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.word = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.word).astype(np.int64))]).astype(np.int32)
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        at = i >> 6
        rest = self.word[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at] + np.bitwise_count(rest)


class WaveletMatrix:
    """Rank of any symbol in a sequence of symbols below 2^levels."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, now = [], symbols
        for level in reversed(range(self.levels)):
            bit = (now >> level) & 1
            self.bits.append(Bits(bit.astype(np.uint8)))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        everything = np.arange(size)
        self.base = self._down(everything, np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in zip(reversed(range(self.levels)), self.bits):
            ones = bits.ones(i)
            i = np.where((symbol >> level) & 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs among the first ``i``."""
        return self._down(symbol, i) - self.base[symbol]


class FMIndex:
    """Index of ``sequences`` (arrays of 64-bit words); symbol 0 closes each."""

    def __init__(self, sequences: list[np.ndarray], length: int):
        self.sizes = np.array([len(s) for s in sequences])
        self.start = np.cumsum(self.sizes + 1) - self.sizes - 1
        words, coded = np.unique(np.concatenate(sequences), return_inverse=True)
        self.text = np.zeros(int(self.sizes.sum()) + len(sequences), np.int64)
        inside = np.ones(len(self.text), bool)
        inside[self.start + self.sizes] = False
        self.text[inside] = coded + 1
        self.owner = np.repeat(np.arange(len(sequences)), self.sizes + 1)
        rank, ranks, done = self.text, {}, 1
        while done < DEPTH:
            ranks[done] = rank
            behind = np.concatenate([rank[done:], np.zeros(min(done, len(rank)), np.int64)])[: len(rank)]
            rank = np.unique(rank * (int(rank.max()) + 1) + behind, return_inverse=True)[1]
            done *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=len(words) + 1))])[:-1]
        self.tree = WaveletMatrix(self.text[self.suffixes - 1], len(words) + 1)
        # where the first ``length`` words change from one suffix to the next
        half = max(d for d in ranks if d <= length)
        other = np.concatenate([ranks[half][length - half :], np.zeros(length - half, np.int64)])[: len(rank)]
        a, b = ranks[half][self.suffixes], other[self.suffixes]
        new = np.ones(len(rank), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.block_start = np.flatnonzero(new)
        self.block = np.cumsum(new) - 1
        self.length = length

    def extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Intervals of the patterns with one word more in front."""
        first = self.counts[symbol]
        return first + self.tree.rank(symbol, low), first + self.tree.rank(symbol, high)

    def least(self, value: np.ndarray) -> np.ndarray:
        """Least value (one per sequence) among the occurrences in each interval of ``length`` equal words."""
        return np.minimum.reduceat(value[self.owner[self.suffixes]], self.block_start)

    def matches(self):
        """Stream every sequence backwards through the index. Yields the place in each sequence where a match of ``length``
        words begins and the number of its interval; a longer match is cut to ``length``, so its statistic never falls."""
        lanes = np.arange(len(self.sizes))
        low, high = np.zeros(len(lanes), np.int64), np.full(len(lanes), len(self.text))
        ends = np.append(self.block_start[1:], len(self.text))
        for step in range(int(self.sizes.max())):
            lanes = lanes[self.sizes[lanes] > step]
            place = self.sizes[lanes] - 1 - step
            symbol = self.text[self.start[lanes] + place]
            low[lanes], high[lanes] = self.extended(symbol, low[lanes], high[lanes])
            if step + 1 >= self.length:
                block = self.block[low[lanes]]
                low[lanes], high[lanes] = self.block_start[block], ends[block]
                yield lanes, place, block
