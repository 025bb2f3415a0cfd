"""Periodic runs of words, found by recursive frequency splitting and a lag scan of what is left.

A run of period q covers at least two periods, so each of its words occurs twice or more in any segment around it. A word that
occurs once in its segment can join no run there: it splits the segment. Counts are taken again in the parts until no word
splits any more; parts below ``LEAST`` words hold no run. In the segments that survive, a run is a stretch of words that equal
the word q places on. Lags below ``DIRECT`` are compared place by place. For lags of 2b up to 4b a stretch holds a whole block
of b words at a multiple of b; blocks are named by doubling (equal names, equal words), and a block is only compared with
places of its own name 2b to 4b further on. Chains of such blocks are then drawn out to both sides by names of halved length,
so the work is n log n also where whole texts are one word. Stretches of one extent are one run, of the least lag.

Everything about a text is in its own row, so nothing is shuffled. Words are equal if their 64-bit hashes are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import table
from .quality_rules import words_of

LEAST = 12
DIRECT = 8
#: Rounds of splitting stop when they have counted each word of a batch so often; the scan is exact on unsettled parts, too.
MOST_COUNTS = 64
#: So many pairs of places are held at a time.
PAIRS = 1 << 20
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def segments(ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words in surviving segments, in order, and the number of each one's segment."""
    kinds = int(ids.max()) + 1 if len(ids) else 1
    place, part, done, budget = np.arange(len(ids)), row, [], MOST_COUNTS * len(ids)
    while True:
        if len(place):
            new = np.ones(len(place), bool)
            new[1:] = (np.diff(place) != 1) | (np.diff(part) != 0)
            part = np.cumsum(new) - 1
            long = np.bincount(part)[part] >= LEAST
            place, part = place[long], part[long]
        if not len(place) or budget < 0:
            done.append(place)
            break
        budget -= len(place)
        _, which, counts = np.unique(part * kinds + ids[place], return_inverse=True, return_counts=True)
        rare = counts[which] < 2
        split = np.zeros(int(part[-1]) + 1, bool)
        split[part[rare]] = True
        settled = ~split[part]
        done.append(place[settled])
        place, part = place[split[part] & ~rare], part[split[part] & ~rare]
    place = np.sort(np.concatenate(done))
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(place) != 1) | (row[place[1:]] != row[place[:-1]])
    return place, np.cumsum(new) - 1


def _doubled(name: np.ndarray, size: int) -> np.ndarray:
    """Names of blocks of twice the ``size``; -1 for blocks that stand only once."""
    out = np.full(len(name), -1)
    if len(name) > size:
        left, right = name[:-size], name[size:]
        at = np.flatnonzero((left >= 0) & (right >= 0))
        _, which, counts = np.unique(left[at] * (len(name) + 1) + right[at], return_inverse=True, return_counts=True)
        out[at] = np.where(counts[which] > 1, which, -1)
    return out


def _same(name: np.ndarray, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Whether the blocks at ``at`` and ``lag`` places on are equal."""
    inside = (at >= 0) & (at + lag < len(name))
    a, b = name[np.where(inside, at, 0)], name[np.where(inside, at + lag, 0)]
    return inside & (a >= 0) & (a == b)


def _stretches(names: dict[int, np.ndarray], block: int):
    """First place, length and lag of the longest stretches of equal words for lags from 2 to 4 blocks."""
    name = names[block]
    n, known = len(name), np.flatnonzero(name >= 0)
    ordered = np.sort(name[known] * n + known)
    grid = known[known % block == 0]
    low = np.searchsorted(ordered, name[grid] * n + np.minimum(grid + 2 * block, n))
    high = np.searchsorted(ordered, name[grid] * n + np.minimum(grid + 4 * block, n))
    total, ends = np.cumsum(high - low), ([], [])
    cuts = np.unique(np.searchsorted(total, np.arange(PAIRS, total[-1] + PAIRS, PAIRS))) if len(grid) else []
    for a, b in zip(np.concatenate([[0], cuts]).astype(int), np.append(cuts, len(grid)).astype(int)):
        count = high[a:b] - low[a:b]
        at = np.repeat(grid[a:b], count)
        other = ordered[np.repeat(low[a:b] - (np.cumsum(count) - count), count) + np.arange(len(at))] % n
        lag = other - at
        for side, step in zip(ends, (-block, block)):
            edge = ~_same(name, at + step, lag)
            side.append(np.stack([lag[edge], at[edge]]))
    (lag, first), (_, last) = (x[:, np.lexsort(x[::-1])] for x in (np.concatenate(side, axis=1) for side in ends))
    begin, end, size = first.copy(), last + block, block // 2
    while size:
        begin -= size * _same(names[size], begin - size, lag)
        end += size * _same(names[size], end, lag)
        size //= 2
    return begin, end - begin, lag


def runs_of(ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first word, length and period of every run, by place and period; ``row`` tells the texts apart."""
    place, part = segments(ids, row)
    at = np.arange(len(place)) + part + 1
    n = len(place) + (int(part[-1]) + 1 if len(part) else 0) + 1
    line, origin = -1 - np.arange(n), np.zeros(n, np.int64)
    line[at], origin[at] = np.unique(ids[place], return_inverse=True)[1], place
    longest = int(np.bincount(part).max()) if len(part) else 0
    found = [np.zeros((3, 0), np.int64)]
    for lag in range(1, min(DIRECT, longest // 2 + 1)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], line[:-lag] == line[lag:], [0]]).astype(np.int8)))
        found.append(np.stack([edge[::2], edge[1::2] - edge[::2], np.full(len(edge) // 2, lag)]))
    names, size = {1: np.maximum(line, -1)}, 1
    while 4 * size <= longest:
        names[2 * size] = _doubled(names[size], size)
        size *= 2
        if 2 * size >= DIRECT and (names[size] >= 0).any():
            found.append(np.stack(_stretches(names, size)))
        elif 2 * size >= DIRECT:
            break
    begin, length, lag = np.concatenate(found, axis=1)
    enough = length >= np.maximum(LEAST - lag, lag)
    begin, length, lag = begin[enough], (length + lag)[enough], lag[enough]
    order = np.lexsort((lag, length, begin))
    begin, length, lag = begin[order], length[order], lag[order]
    least = np.ones(len(begin), bool)
    least[1:] = (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])
    begin, length, lag = origin[begin[least]], length[least], lag[least]
    order = np.lexsort((lag, begin))
    return begin[order], length[order], lag[order]


def _joined(w: W.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one blank."""
    row, start, size = w.row[keep], w.start[keep], (w.end - w.start)[keep]
    lead = np.ones(len(row), np.int64)
    lead[:1] = 0
    lead[1:] = row[1:] == row[:-1]
    ends = np.cumsum(size + lead)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    step = max(1, PAIRS // 8)
    for i in range(0, len(row), step):
        s, e = size[i : i + step], ends[i : i + step]
        shift = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
        out[np.repeat(e - s, s) + shift] = w.data[np.repeat(start[i : i + step], s) + shift]
    bounds = np.concatenate([[0], ends])[np.searchsorted(row, np.arange(len(w.first)))]
    return pa.LargeStringArray.from_buffers(len(w.first) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def _found(batches):
    for batch in batches:
        w = W.words(batch["text"], W.FIELDS)
        row = w.row
        begin, length, period = runs_of(np.unique(w.hash, return_inverse=True)[1], row)
        change = np.zeros(len(row) + 1, np.int64)
        np.add.at(change, begin + period, 1)
        np.add.at(change, begin + length, -1)
        mine = row[begin]
        runs = pa.StructArray.from_arrays(
            [pa.array(x, pa.int64()) for x in (begin - w.first[mine], length, period)], ["start", "length", "period"])
        offsets = pa.array(np.searchsorted(mine, np.arange(batch.num_rows + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*[c for c, name in zip(batch.columns, batch.schema.names) if name != "text"], pa.array(w.count, pa.int64()),
             pa.ListArray.from_arrays(offsets, runs), _joined(w, np.cumsum(change[:-1]) == 0)],
            [*[name for name in batch.schema.names if name != "text"], "n_words", "runs", "collapsed"])


def periodic_runs(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed; one row per row of ``documents``.

    ``collapsed`` are the words outside all runs and those of each run's first period, joined by one blank; a word in the first
    period of one run goes if another run repeats it. Null, empty and blank texts have no words, no runs and an empty
    ``collapsed``; rows with null or equal doc_id keep their own results. Other columns are ignored.
    """
    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(_found, f"doc_id {kind}, n_words bigint, runs {RUN}, collapsed string")


def repeated_tail(doc_id: Column, words: Column) -> Column:
    """Words of a test text: in one document of ten, those behind some place become copies of the first few behind it."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    n, g = F.size(words), F.floor(crc / 10)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    tail = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))
    return F.when((crc % 10 == 0) & (n > 0), F.array_join(tail, " "))


def op11(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", words_of(F.col("text")).alias("words"))
    rows = periodic_runs(docs.select("doc_id", F.coalesce(repeated_tail(F.col("doc_id"), F.col("words")), "text").alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return rows.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"), F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
