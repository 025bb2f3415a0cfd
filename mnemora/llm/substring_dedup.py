"""Substring dedup: runs of WINDOW words that also stand in a document with a smaller id are removed.

Anchors (winnowed ANCHOR-grams of words) are placed so that every window of WINDOW words holds one. Anchors that only one
document has are dropped. Around each other anchor lies the segment of all windows that hold it; equal segments are one.
Segments are dealt into shards by anchor, so equal windows meet in a shard. A shard builds a compressed FM-index of its
segments and streams them through it by backward search; the intervals that reach WINDOW words give the least doc_id of every
window. Shards hold about SHARD segments; more shards come with more data.

Places of repeated segments are gathered by bucket of documents before they meet the windows of their segment, so a passage
that a third of all documents carry is one row for each bucket, and its rows are spread by bucket.

Texts are shuffled only where a bitmap of bounded size (MAX_BITS) says that they may be concerned; the join behind is exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import bitmap_of, in_bitmap, numbered, released, saved, table
from .fm_index import FMIndex

WINDOW = 50
ANCHOR = 16
SIDE = WINDOW - ANCHOR
SHARD = 2048
MAX_BITS = 24
PLACES = 16384
LAST = (1 << 63) - 1


def _segment_bounds(pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(pos - SIDE, 0), np.minimum(pos + WINDOW, n)


def _anchors(batches):
    """Anchors of texts with at least one window: hash, hash of the segment, place."""
    for batch in batches:
        w = W.words(batch["text"], W.FIELDS)
        gram, left = W.long_grams(w.hash, ANCHOR), w.left()
        at = W.winnowed(gram, left[: len(gram)] >= WINDOW, SIDE + 1)
        row = w.row[at] if len(at) else at
        pos = at - w.first[row]
        begin, end = _segment_bounds(pos, w.count[row])
        # a segment's hash: prefix sums of the words' hashes, weighted by place
        up, down = W.powers(len(w.hash) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * up[: len(w.hash)], dtype=np.uint64)])
        a, b = w.first[row] + begin, w.first[row] + end
        segment = W.mixed((total[b] - total[a]) * down[a] + (pos - begin).astype(np.uint64) * W.GRAM + (end - pos).astype(np.uint64))
        ids = np.where(np.asarray(batch["doc_id"].is_null()), LAST, batch["doc_id"].fill_null(0).to_numpy())
        yield pa.RecordBatch.from_arrays([
            pa.array(gram[at].view(np.int64)), pa.array(segment.view(np.int64)), pa.array(batch["rid"].to_numpy()[row]),
            pa.array(ids[row], pa.int64()), pa.array(pos, pa.int32()),
        ], ["anchor", "segment", "rid", "doc", "pos"])


def _texts(held, bits: int):
    def run(batches):
        hit = np.unpackbits(np.frombuffer(held.value, np.uint8)).view(bool)
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(hit, bits, batch["rid"].to_numpy())))

    return run


def _segments(batches):
    """Words of the chosen segments."""
    for batch in batches:
        w = W.words(batch["text"], W.FIELDS)
        out = {"anchor": [], "segment": [], "doc": [], "most": [], "words": []}
        for i, chosen in enumerate(batch["chosen"].to_pylist()):
            mine = w.hash[w.first[i] : w.first[i + 1]]
            for x in chosen:
                begin, end = _segment_bounds(x["pos"], len(mine))
                for name in ("anchor", "segment", "doc", "most"):
                    out[name].append(x[name])
                out["words"].append(mine[begin:end].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[n], pa.int64()) for n in ("anchor", "segment", "doc", "most")] + [pa.array(out["words"], pa.binary())], list(out))


def _sources(rows: pd.DataFrame) -> pd.DataFrame:
    """Per segment of a shard, its windows in runs of one least doc_id: first window, number of windows, doc_id. Runs that no
    document with this segment comes after are left out."""
    index = FMIndex([np.frombuffer(x, np.uint64) for x in rows["words"]], WINDOW)
    least = index.least(rows["doc"].to_numpy())
    found = [(lane, place, least[block]) for lane, place, block in index.matches()]
    lane, place, doc = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, lane))
    lane, place, doc = lane[order], place[order], doc[order]
    new = np.ones(len(lane), bool)
    new[1:] = (lane[1:] != lane[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(lane)))
    older = doc[begin] < rows["most"].to_numpy()[lane[begin]]
    begin, size = begin[older], size[older]
    return pd.DataFrame({
        "anchor": rows["anchor"].to_numpy()[lane[begin]], "segment": rows["segment"].to_numpy()[lane[begin]],
        "first": place[begin], "n": size, "source": doc[begin],
    })


def _likely(held, bits: int):
    """Anchors whose segment may be one with sources."""

    def run(batches):
        hit = np.unpackbits(np.frombuffer(held.value, np.uint8)).view(bool)
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(hit, bits, batch["segment"].to_numpy())))

    return run


def _ranges(rows: pa.Table) -> pa.Table:
    """Word ranges of each document of a bucket, from rows (places of a segment, runs of its windows), joined where they meet."""
    found = [np.zeros((3, 0), np.int64)]
    for batch in rows.to_batches():
        places, runs = batch["places"], batch["runs"]
        first_run = runs.offsets.to_numpy()[:-1] - runs.offsets[0].as_py()
        row = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
        rid, doc, pos = (places.flatten().field(name).to_numpy().astype(np.int64) for name in ("rid", "doc", "pos"))
        first, n, source = (runs.flatten().field(name).to_numpy().astype(np.int64) for name in ("first", "n", "source"))
        many = np.diff(runs.offsets.to_numpy())[row]  # every place meets every run of its row
        at = np.repeat(np.arange(len(row)), many)
        run = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + first_run[row[at]]
        older = source[run] < doc[at]
        at, run = at[older], run[older]
        begin = np.maximum(pos[at] - SIDE, 0) + first[run]
        found.append(np.stack([rid[at], begin, begin + n[run] - 1 + WINDOW]))
    rid, begin, end = np.concatenate(found, axis=1)
    order = np.lexsort((begin, rid))
    rid, begin, end = rid[order], begin[order], end[order]
    docs, number = np.unique(rid, return_inverse=True)
    reach = np.maximum.accumulate(number * (1 << 40) + end) - number * (1 << 40)  # furthest end so far in the document
    new = np.ones(len(rid), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (begin[1:] > reach[:-1])
    start = np.flatnonzero(new)
    last = np.append(start, len(rid))[1:] - 1
    ranges = pa.StructArray.from_arrays(
        [pa.array(begin[start], pa.int32()), pa.array(reach[last], pa.int32())], ["begin", "end"])
    offsets = np.append(np.searchsorted(rid[start], docs), len(start))
    return pa.table({"rid": pa.array(docs), "ranges": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ranges)})


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """rid and the array of word ranges (begin, end) that windows of smaller documents cover; rows: rid, doc_id, text."""
    anchors = saved(
        rows.select("rid", "doc_id", "text").mapInArrow(released(_anchors), "anchor long, segment long, rid long, doc long, pos int"), "anchors")
    shared = anchors.groupBy("anchor", "segment").agg(
        F.min(F.struct("doc", "rid", "pos")).alias("first"), F.max("doc").alias("most"))
    docs = shared.groupBy("anchor").agg(F.min("first.doc").alias("lo"), F.max("most").alias("hi")).where("lo < hi").select("anchor")
    distinct = saved(shared.join(docs, "anchor").select("anchor", "segment", "first.doc", "first.rid", "first.pos", "most"), "segments")
    chosen = distinct.groupBy("rid").agg(F.collect_list(F.struct("anchor", "segment", "doc", "pos", "most")).alias("chosen"))
    held, bits = bitmap_of(distinct, "rid", MAX_BITS)
    texts = rows.select("rid", "text").mapInArrow(_texts(held, bits), "rid long, text string").join(chosen, "rid")
    full = texts.select("text", "chosen").mapInArrow(released(_segments), "anchor long, segment long, doc long, most long, words binary")
    shards = max(1, distinct.count() // SHARD)
    sources = saved(
        full.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInPandas(
            _sources, "anchor long, segment long, first int, n int, source long"),
        "sources",
    )
    runs = sources.groupBy("anchor", "segment").agg(F.collect_list(F.struct("first", "n", "source")).alias("runs"))
    held, bits = bitmap_of(sources, "segment", MAX_BITS)
    bucket = F.pmod(F.xxhash64("rid"), F.lit(max(1, anchors.count() // PLACES)))
    packed = anchors.mapInArrow(released(_likely(held, bits)), anchors.schema).groupBy("anchor", "segment", bucket.alias("bucket")).agg(
        F.collect_list(F.struct("rid", "doc", "pos")).alias("places"))
    met = packed.join(runs, ["anchor", "segment"]).select("bucket", "places", "runs")
    return met.groupBy("bucket").applyInArrow(_ranges, "rid long, ranges array<struct<begin: int, end: int>>")


def _kept(text: bytes, ranges) -> tuple[int, list[bytes]]:
    """Number of words, and those outside the ranges."""
    words = text.split()
    if not ranges:
        return len(words), words
    edge = np.zeros(len(words) + 1, np.int64)
    for r in ranges:
        edge[r["begin"]] += 1
        edge[r["end"]] -= 1
    return len(words), [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]


def deduplicated(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one blank) for every row of ``documents``.

    Null text has no words, a text of fewer than WINDOW words keeps all. A null doc_id is greater than any other; rows with
    equal doc_id do not remove from one another. ``documents`` must give its rows in the same order each time, as a scan does.
    """
    return _finished(documents, "kept string", lambda kept: kept.decode("utf-8", "replace"))


def _finished(documents: DataFrame, column: str, form) -> DataFrame:
    """One row per row of documents. Texts that no range can concern are finished where they lie; the rest meets its ranges."""
    rows = numbered(documents.select("doc_id", "text"))
    ranges = saved(repeated_ranges(rows), "ranges")
    held, bits = bitmap_of(ranges, "rid", MAX_BITS)

    def finish(texts, ranges):
        out = [_kept(t or b"", r) for t, r in zip(texts, ranges)]
        return (pa.array([n for n, _ in out], pa.int64()), pa.array([n - len(k) for n, k in out], pa.int64()),
                pa.array([form(b" ".join(k)) for _, k in out], pa.string()))

    def first(batches):
        hit = np.unpackbits(np.frombuffer(held.value, np.uint8)).view(bool)
        for batch in batches:
            later = in_bitmap(hit, bits, batch["rid"].to_numpy())
            texts = batch["text"].cast(pa.binary()).to_pylist()
            done = finish([None if x else t for t, x in zip(texts, later)], [None] * len(texts))
            waiting = pa.array([t if x else None for t, x in zip(texts, later)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch["rid"], batch["doc_id"], pa.array(later), waiting, *done],
                ["rid", "doc_id", "later", "waiting", "n_words", "n_removed", column.split()[0]])

    def second(batches):
        for batch in batches:
            done = finish(batch["waiting"].to_pylist(), batch["ranges"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["doc_id"], *done], ["rid", "doc_id", "n_words", "n_removed", column.split()[0]])

    kinds = f"rid long, doc_id long, n_words long, n_removed long, {column}"
    seen = saved(
        rows.select("rid", "doc_id", "text").mapInArrow(
            released(first), f"rid long, doc_id long, later boolean, waiting binary, n_words long, n_removed long, {column}"),
        "texts",
    )
    rest = seen.where("later").select("rid", "doc_id", "waiting").join(ranges, "rid", "left").mapInArrow(released(second), kinds)
    return seen.where("NOT later").drop("later", "waiting").unionByName(rest)


def op10(spark, sf_dir: str) -> DataFrame:
    rows = _finished(table(spark, sf_dir, "documents"), "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def shortened(documents: DataFrame) -> DataFrame:
    """``documents`` with all columns; texts that lose words are what they keep, joined by one blank, n_chars follows."""
    rows = numbered(documents, "__rid")
    kept = _finished(documents, "kept string", lambda kept: kept.decode("utf-8", "replace"))
    kept = kept.where("n_removed > 0").select(F.col("rid").alias("__rid"), F.col("kept").alias("__text"))
    joined = rows.join(kept, "__rid", "left")
    columns = {"text": F.coalesce("__text", "text")}
    if "n_chars" in documents.columns:
        columns["n_chars"] = F.when(F.col("__text").isNull(), F.col("n_chars")).otherwise(F.length("__text").cast("long"))
    return joined.withColumns(columns).select(*documents.columns)


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s
  FROM d, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
first AS (SELECT s, min(doc_id) AS source FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, j FROM windows JOIN first USING (s), unnest(range(i, i + 50)) AS t(j) WHERE source < doc_id),
places AS (SELECT doc_id, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(j)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, j)
  GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
