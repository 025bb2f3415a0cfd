"""Benchmark decontamination by winnowing.

Words of both sides are hashed; of every ``WINDOW - K + 1`` consecutive K-grams the one with the least hash is kept. Two
texts that share WINDOW words keep a common K-gram inside them, so joining kept K-grams finds every such span. A kept K-gram
carries the WINDOW - K words on either side of it: enough to extend a hit to every window that holds the K-gram.

Documents' K-grams first pass a bitmap of the benchmark's K-grams, whose size is bounded (``MAX_BITS``); false positives
end in the join. So the shuffle carries hits, not documents, unless the benchmark is as large as the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import numbered, saved, table

WINDOW = 10
K = 5
SIDE = WINDOW - K
SPAN = WINDOW + SIDE
MAX_BITS = 27
GRAMS = "kind int, gram long, pos int, around binary"


def _contexts(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, pos: np.ndarray, gap: int) -> list[bytes]:
    """SPAN word hashes around each place, those outside its text replaced by ``gap``."""
    at = pos[:, None] + np.arange(-SIDE, SPAN - SIDE)
    inside = (at >= first[:, None]) & (at < last[:, None])
    rows = np.where(inside, hashes[np.clip(at, 0, max(len(hashes) - 1, 0))], np.uint64(gap)) if len(pos) else at
    return [r.tobytes() for r in rows.astype(np.uint64)]


def _kept(w: W.Words, lengths, gap: int):
    """Per kind of gram (K: winnowed; shorter windows: all): kind, gram hash, place in the text, row, context."""
    left, row = w.left(), w.row
    found = []
    gram = W.grams(w.hash, K)
    if len(gram):
        chosen = W.winnowed(gram, left[: len(gram)] >= WINDOW, WINDOW - K + 1)
        found.append((0, gram[chosen], chosen))
    for n in lengths:
        gram = W.grams(w.hash, n)
        if len(gram):
            fits = np.flatnonzero(left[: len(gram)] >= n)
            found.append((n, gram[fits], fits))
    for kind, gram, at in found:
        yield kind, gram, at, row[at], lambda pick, at=at: (
            (at - w.first[row[at]])[pick],
            _contexts(w.hash, w.first[row[at[pick]]], w.first[row[at[pick]] + 1], at[pick], gap),
        )


def _item_grams(batches):
    for batch in batches:
        w = W.words(batch["text"], W.ALNUM, lower=True)
        ids = batch["item_id"].to_numpy(zero_copy_only=False)
        sizes = w.count
        for n in (0, *range(1, WINDOW)):
            for kind, gram, at, row, context in _kept(w, [n] if n else [], 1):
                pick = np.flatnonzero((kind == n) & ((sizes[row] == n) if n else (sizes[row] >= WINDOW)))
                pos, around = context(pick)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[row[pick]], pa.int64()), pa.array(np.full(len(pick), kind), pa.int32()),
                    pa.array(gram[pick].view(np.int64)), pa.array(pos, pa.int32()), pa.array(around, pa.binary()),
                ], ["item_id", "kind", "gram", "pos", "around"])


def _slots(gram: np.ndarray, kind: int, bits: int) -> np.ndarray:
    return ((gram + np.uint64(kind) * W.GRAM) >> np.uint64(64 - bits)).astype(np.int64)


def item_grams(items: DataFrame) -> DataFrame:
    """Kept grams of the benchmark. An item of fewer than WINDOW words is one window of kind 'its length'."""
    items = items.where("item_id IS NOT NULL").select("item_id", "text")
    return items.mapInArrow(_item_grams, "item_id long, " + GRAMS)


def bitmap(grams: DataFrame) -> tuple[bytes, int, list[int]]:
    """Bits of the benchmark's grams, at most 2^MAX_BITS: merged by Spark, one bounded value for the driver."""
    n = grams.count()
    bits = min(MAX_BITS, max(12, int(16 * n).bit_length()))

    def mark(batches):
        out = np.zeros(1 << bits, bool)
        for batch in batches:
            gram = batch["gram"].to_numpy().view(np.uint64)
            out[_slots(gram, 0, bits) if not len(gram) else
                ((gram + batch["kind"].to_numpy().astype(np.uint64) * W.GRAM) >> np.uint64(64 - bits)).astype(np.int64)] = True
        where = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(where >> 12), pa.array(where & 4095)], ["block", "bit"])

    marks = grams.select("gram", "kind").mapInArrow(mark, "block long, bit long").groupBy("block").agg(
        F.collect_set("bit").alias("bits")
    )
    full = np.zeros(1 << bits, bool)
    for row in marks.toLocalIterator():
        full[(row["block"] << 12) + np.array(row["bits"], np.int64)] = True
    lengths = [r["kind"] for r in grams.where("kind > 0").select("kind").distinct().collect()]
    return np.packbits(full).tobytes(), bits, sorted(lengths)


def _doc_grams(packed, bits: int, lengths: list[int]):
    def run(batches):
        hit = np.unpackbits(np.frombuffer(packed.value, np.uint8)).view(bool)
        for batch in batches:
            w = W.words(batch["text"], W.ALNUM, lower=True)
            n = batch.num_rows
            out = [[], [], [], [], [], []]
            for kind, gram, at, row, context in _kept(w, lengths, 2):
                pick = np.flatnonzero(hit[_slots(gram, kind, bits)])
                pos, around = context(pick)
                for column, values in zip(out, (row[pick], np.full(len(pick), kind), gram[pick].view(np.int64), pos, [around])):
                    column.append(values)
            rid = batch["rid"].to_numpy()
            around = [x for part in out[4] for lists in part for x in lists]
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out[:4]]
            order = np.argsort(flat[0], kind="stable")
            seeds = pa.StructArray.from_arrays([
                pa.array(flat[1][order], pa.int32()), pa.array(flat[2][order], pa.int64()), pa.array(flat[3][order], pa.int32()),
                pa.array([around[i] for i in order], pa.binary()),
            ], ["kind", "gram", "pos", "around"])
            offsets = np.searchsorted(flat[0][order], np.arange(n + 1))
            yield pa.RecordBatch.from_arrays([
                pa.array(rid), batch["doc_id"], pa.array(w.count, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), seeds),
            ], ["rid", "doc_id", "n_words", "seeds"])

    return run


def _extended(batches):
    """Ranges of document words that lie in shared windows, from pairs of equal grams."""
    for batch in batches:
        n = batch.num_rows
        sides = [np.frombuffer(b"".join(batch[c].to_pylist()), np.uint64).reshape(n, SPAN) for c in ("around", "item_around")]
        same = sides[0] == sides[1]
        kind, pos = batch["kind"].to_numpy(), batch["pos"].to_numpy()
        before = np.logical_and.accumulate(same[:, SIDE - 1 :: -1], axis=1).sum(axis=1) if SIDE else 0
        after = np.logical_and.accumulate(same[:, SIDE:], axis=1).sum(axis=1)
        short = kind > 0
        good = np.where(short, after >= kind, before + after >= WINDOW) & (short | (after >= K))
        begin = np.where(short, pos, pos - before)[good]
        end = np.where(short, pos + kind, pos + after)[good]
        yield pa.RecordBatch.from_arrays([
            pa.array(batch["rid"].to_numpy()[good]), pa.array(batch["item_id"].to_numpy()[good]),
            pa.array(begin, pa.int64()), pa.array(end, pa.int64()),
        ], ["rid", "item_id", "begin", "end"])


def contamination(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of ``documents``: rid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Needs doc_id and text, and item_id and text; other columns are ignored. Null or wordless texts have no words and no
    hits; rows with equal or null doc_id are judged apart. Items without id are left out; rows of one item_id are windows of
    that one item. An empty benchmark hits nothing.
    """
    grams = saved(item_grams(items), "benchmark-grams")
    packed, bits, lengths = bitmap(grams)
    held = documents.sparkSession.sparkContext.broadcast(packed)
    rows = numbered(documents.select("doc_id", "text"))
    seen = saved(
        rows.select("rid", "doc_id", "text").mapInArrow(
            _doc_grams(held, bits, lengths), f"rid long, doc_id long, n_words long, seeds array<struct<{GRAMS.replace(' ', ':').replace(',:', ',')}>>"
        ),
        "document-grams",
    )
    seeds = seen.where(F.size("seeds") > 0).select("rid", F.explode("seeds").alias("s")).select("rid", "s.*")
    other = grams.select("item_id", "kind", "gram", F.col("around").alias("item_around"))
    pairs = seeds.join(other, ["kind", "gram"]).select("rid", "item_id", "kind", "pos", "around", "item_around")
    hits = saved(pairs.mapInArrow(_extended, "rid long, item_id long, begin long, end long"), "hits")
    spans = hits.groupBy("rid", "begin").agg(F.max("end").alias("end"))
    before = Window.partitionBy("rid").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce(F.max("end").over(before), F.lit(0))))
    n_hit = spans.select("rid", covered.alias("n")).groupBy("rid").agg(F.sum("n").alias("n_hit"))
    found = hits.select("rid", F.col("item_id").cast("string").alias("item")).distinct().groupBy("rid").agg(
        F.array_sort(F.collect_list("item")).alias("items")
    )
    none = F.array().cast("array<string>")
    return seen.drop("seeds").join(n_hit, "rid", "left").join(found, "rid", "left").select(
        "rid", "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")


def decontaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``documents`` without shared windows; all columns are kept."""
    hit = contamination(documents, items).where("contaminated").select(F.col("rid").alias("__rid"))
    rows = numbered(documents, "__rid")
    return rows.join(hit, "__rid", "left_anti").drop("__rid")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.s = x.s),
hit_words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
