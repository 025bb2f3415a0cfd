"""Words of whole Arrow text columns as arrays: places and 64-bit hashes, without a Python object per word.

Texts are cut by classes of UTF-8 bytes: a word is a longest run of bytes of one class, class 0 separates. A word's hash is
a polynomial over fixed random byte values modulo 2^64 with a final mix. Two given words agree with probability 2^-64;
operators compare sequences of ten or more hashes, or sets of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANKS = b"\t\n\x0b\x0c\r "
CHUNK = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
GRAM = np.uint64(0x2545F4914F6CDD1D)
LONG = np.uint64(0xFFFFFFFFFFFFFFFF)


def _classes(alnum: int, other: int) -> np.ndarray:
    table = np.full(256, other, np.uint8)
    table[[c for c in range(256) if c >= 0x80 or chr(c).isalnum()]] = alnum
    table[list(BLANKS)] = 0
    return table


ALNUM = _classes(1, 0)
FIELDS = _classes(1, 1)
PROSE = _classes(1, 2)


def _byte_values(lower: bool) -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    return values


VALUES = {False: _byte_values(False), True: _byte_values(True)}
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, kept for the next call."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            steps = np.full(n, np.uint64(base))
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of a batch: byte range in ``data``, hash and class of each; those of row i are first[i]:first[i + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    kind: np.ndarray
    first: np.ndarray
    stems: np.ndarray | None = None

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def left(self) -> np.ndarray:
        """How many words of the same text follow each word, itself included."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.hash))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(column: pa.Array, classes: np.ndarray, lower: bool = False, stems: tuple[int, ...] = ()) -> Words:
    """Cut the texts of ``column``. ``stems``: also hash the first so many bytes of each word. Works in pieces of about 64 KB of text, cut between words, so memory stays bounded."""
    data, offsets = text_buffer(column)
    parts, at = [], 0
    while at < len(data):
        stop = min(len(data), at + CHUNK)
        while stop < len(data):  # not inside a word
            gaps = np.flatnonzero(classes[data[at + 1 : stop + 1]] == 0)
            if len(gaps):
                stop = at + 1 + int(gaps[-1])
                break
            stop = min(len(data), at + 2 * (stop - at))
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop, "right")]
        parts.append(_cut(data[at:stop], inner - at, classes, lower, at, stems))
        at = stop
    start, end, hashes, kind, stem = (np.concatenate(x) for x in zip(*parts)) if parts else (
        np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8),
        np.zeros((0, len(stems)), np.uint64))
    return Words(data, start, end, hashes, kind, np.searchsorted(start, offsets), stem)


def _cut(data: np.ndarray, edges: np.ndarray, classes: np.ndarray, lower: bool, at: int, stems: tuple[int, ...]):
    kinds = classes[data]
    change = np.empty(len(data) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:-1])
    change[edges] = True
    bounds = np.flatnonzero(change)
    start, end = bounds[:-1], bounds[1:]
    keep = kinds[start] != 0
    start, end = start[keep], end[keep]
    up, down = powers(max(CHUNK, len(data)))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[lower][data] * up[: len(data)], out=total[1:])
    stem = np.empty((len(start), len(stems)), np.uint64)
    for j, n in enumerate(stems):
        stem[:, j] = mixed((total[np.minimum(start + n, end)] - total[start]) * down[start] + np.uint64(n))
    return start + at, end + at, mixed((total[end] - total[start]) * down[start]), kinds[start], stem


def hash_of(word: str, lower: bool = True) -> int:
    """The hash that ``words`` gives to one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(mixed(np.array([(VALUES[lower][data] * powers(CHUNK)[0][: len(data)]).sum(dtype=np.uint64)]))[0])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words that begins at a place; the caller leaves out runs over the end of a text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * GRAM + hashes[j : j + n]
    return mixed(out)


def long_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """As ``grams`` for a large ``k``, by doubling: log2(k) passes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, factor, done, out = hashes, 1, int(GRAM), 0, np.zeros(n, np.uint64)
    while True:
        if k & size:
            out = out * np.uint64(factor) + power[done : done + n]
            done += size
        if done == k:
            return mixed(out)
        power = power[: len(power) - size] * np.uint64(factor) + power[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)


def winnowed(gram: np.ndarray, fits: np.ndarray, window: int) -> np.ndarray:
    """Places of the minimum of each ``window`` consecutive grams, the last one of equal minima.

    ``fits[i]``: the window that begins at i lies in one text. Any two texts that share ``window`` consecutive grams share
    a place chosen here.
    """
    n = len(gram) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place = gram[:n].copy(), np.zeros(n, np.int16)
    for j in range(1, window):
        lower = gram[j : j + n] <= least
        least[lower] = gram[j : j + n][lower]
        place[lower] = j
    begin = np.flatnonzero(fits[:n])
    chosen = np.zeros(len(gram), bool)
    chosen[begin + place[begin]] = True
    return np.flatnonzero(chosen)
