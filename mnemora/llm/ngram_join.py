"""N-gram Jaccard join by a size-aware heavy-light join.

A document's set holds the hashes of its distinct shingles, of 3 words for op6. Sets are ordered rarest first: what a sample
of documents shows to be common goes last. Two sets with Jaccard >= t, 0.9 for op6, miss at most f = floor((1 - t) * size)
of each other's shingles, so

* light sets (size up to the boundary) share a subset of K shingles among their first f + K: those subsets are enumerated;
* heavy sets share one of their first f + 1 shingles: the inverted list of each such shingle is scanned. Light sets just
  under the boundary are in the lists, too.

The boundary is where enumerating costs as much as scanning, from the mean length of a list. A list is never turned into
pairs: blocks of its members are compared by parity sketches, which bound the symmetric difference from below, and only a
spanning forest of what may be similar leaves the task. The components of these forests are verified exactly in blocks,
again as forests. Equal sets are one set throughout.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import bitmap_of, freed, in_bitmap, numbered, released, removed, saved, table
from .components import components

#: Of op6: words of a shingle, least similarity in percent.
SHINGLE, PERCENT = 3, 90
K = 2
SAMPLE_SHARE = 16
COMMON_COUNT = 2
COMMON_MOST = 1 << 20
SCAN_COST = 1.0
LIST_BLOCK, SET_BLOCK = 1024, 512
SHORT_LIST = 8
BUCKET = 4096
LEAST_BITS, MOST_BITS = 256, 1 << 16
MAX_BITS = 24


def similar(shared, a, b, percent=PERCENT):
    """100 * intersection >= percent * union."""
    return 100 * shared >= percent * (a + b - shared)


def least_size(percent: int) -> int:
    """Smallest size of a set that can be similar to another than an equal one."""
    return -(-percent // (100 - percent))


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in one array, and where each text's begin. A text of fewer words is one
    shingle; one without words has none."""
    w = W.words(column, W.FIELDS, lower=True)
    gram = W.grams(w.hash, shingle)
    fits = w.left()[: len(gram)] >= shingle
    rows, hashes = [w.row[: len(gram)][fits]], [gram[fits]]
    for n in range(1, shingle):
        short = np.flatnonzero(w.count == n)
        whole = np.full(len(short), np.uint64(n))
        for j in range(n):
            whole = W.mixed(whole * W.GRAM + w.hash[w.first[short] + j])
        rows.append(short)
        hashes.append(whole)
    row, found = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    return found[new], np.searchsorted(row[new], np.arange(len(column) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def _set_keys(shingle: int):
    """Two order-free 64-bit sums of each set: with its size, its identity."""

    def run(batches):
        for batch in batches:
            found, first = shingle_sets(batch["text"], shingle)
            yield pa.RecordBatch.from_arrays([
                batch["rid"], batch["doc_id"], pa.array(np.diff(first), pa.int64()),
                pa.array(_sums(W.mixed(found), first).view(np.int64)),
                pa.array(_sums(W.mixed(found ^ W.BASE), first).view(np.int64)),
            ], ["rid", "doc_id", "n_shingles", "key1", "key2"])

    return run


def _sampled(shingle: int):
    def run(batches):
        for batch in batches:
            found, _ = shingle_sets(batch["text"], shingle)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["shingle"])

    return run


def common_shingles(rows: DataFrame, keyed: DataFrame, shingle: int) -> tuple[np.ndarray, float]:
    """Shingles that recur in a sample of one document in SAMPLE_SHARE, rarest first, at most COMMON_MOST of the most
    frequent; and the mean length of a list, with what recurs least counted in. Both steer cost only: any order gives all
    links."""
    chosen = F.pmod(F.xxhash64("rid"), F.lit(SAMPLE_SHARE)) == 0
    sample = rows.where(chosen).select("text")
    total = keyed.where(chosen).agg(F.sum("n_shingles")).first()[0]
    counts = saved(sample.mapInArrow(_sampled(shingle), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    rest = counts.where(F.col("n") < 2 * COMMON_COUNT).agg(F.sum(F.col("n") * (F.col("n") - 1))).first()
    most = counts.where(F.col("n") >= COMMON_COUNT).orderBy(F.desc("n"), "shingle").limit(COMMON_MOST).toArrow()
    found = most["shingle"].to_numpy().view(np.uint64)
    order = np.lexsort((found, most["n"].to_numpy()))
    return found[order], 1.0 + SAMPLE_SHARE * float(rest[0] or 0) / max(1.0, float(total or 0))


def boundary(list_length: float, percent: int = PERCENT) -> int:
    """Largest size whose subsets, (f + 1)(f + 2) / 2 of them, cost no more than f + 1 scans of a list."""
    return int(100 * 2 * (1 + SCAN_COST * list_length) / (100 - percent)) + least_size(percent)


def parity(found: np.ndarray, size: int) -> np.ndarray:
    """Parity of how many shingles fall on each of at least ``size / 2`` bits."""
    bits = 1 << int(np.clip(int(size - 1).bit_length() - 1, LEAST_BITS.bit_length() - 1, MOST_BITS.bit_length() - 1))
    return np.packbits((np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def sketch(found: np.ndarray, percent: int) -> bytes:
    """Parities of a set. Below 85 percent the bound on differing bits is near what unlike sets have in half as many bits."""
    return parity(found, len(found) * (1 if percent >= 85 else 2)).tobytes()


def _keys(common: np.ndarray, edge: int, shingle: int, percent: int):
    rank_of = np.argsort(common, kind="stable")
    ordered = common[rank_of]

    def run(batches):
        for batch in batches:
            found, first = shingle_sets(batch["text"], shingle)
            if len(ordered):
                at = np.minimum(np.searchsorted(ordered, found), len(ordered) - 1)
                rank = np.where(ordered[at] == found, rank_of[at] + 1, 0)
            else:
                rank = np.zeros(len(found), np.int64)
            rid = batch["rid"].to_numpy()
            rids, keys, sketch_of, sketches = [], [], [], []
            for i in range(batch.num_rows):
                mine = found[first[i] : first[i + 1]]
                size = len(mine)
                if size < least_size(percent):  # such a set is similar to an equal one only
                    continue
                f = size * (100 - percent) // 100
                head = mine[np.lexsort((mine, rank[first[i] : first[i + 1]]))[: f + K]]
                own = []
                if size <= edge:
                    a, b = PAIRS.setdefault(len(head), np.array(list(combinations(range(len(head)), 2))).T)
                    low, high = np.minimum(head[a], head[b]), np.maximum(head[a], head[b])
                    own.append(W.mixed(low * W.GRAM + high))
                if 100 * size > percent * edge:
                    own.append(W.mixed(head[: f + 1] ^ W.BASE))
                own = np.concatenate(own)
                rids.append(np.full(len(own), rid[i]))
                keys.append(own)
                sketch_of.append(rid[i])
                sketches.append(sketch(mine, percent))
            sizes = [len(k) for k in keys]
            yield pa.RecordBatch.from_arrays([
                pa.array(sketch_of, pa.int64()),
                pa.array(sketches, pa.binary()),
                pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                    pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64))),
            ], ["rid", "sketch", "keys"])

    return run


PAIRS: dict[int, np.ndarray] = {}


def may_be_similar(sizes: np.ndarray, sketches: list[bytes], percent: int = PERCENT) -> np.ndarray:
    """Matrix of pairs that sizes and parities do not rule out."""
    n = len(sizes)
    total = sizes[:, None] + sizes[None, :]
    ok = 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
    lengths = np.array([len(s) for s in sketches])
    limit = total * (100 - percent) // (100 + percent)
    for length in np.unique(lengths):
        for other in (length, 2 * length):
            at, to = np.flatnonzero(lengths == length), np.flatnonzero(lengths == other)
            if not len(to):
                continue
            left = np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), -1)
            right = np.frombuffer(b"".join(sketches[i] for i in to), np.uint64).reshape(len(to), -1)
            if other != length:
                right = right[:, : right.shape[1] // 2] ^ right[:, right.shape[1] // 2 :]
            apart = np.zeros((len(at), len(to)), np.int64)
            for j in range(left.shape[1]):
                apart += np.bitwise_count(left[:, j][:, None] ^ right[:, j][None, :])
            fits = ok[np.ix_(at, to)] & (apart <= limit[np.ix_(at, to)])
            ok[np.ix_(at, to)] = fits
            ok[np.ix_(to, at)] = fits.T
    ok[(lengths[:, None] > 2 * lengths[None, :]) | (lengths[None, :] > 2 * lengths[:, None])] = False
    ok[np.arange(n), np.arange(n)] = False
    return ok


def _forest(nodes: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Each node with the least node it is connected with by ``linked``."""
    label, high = nodes.copy(), np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], high).min(1))
        if (new == label).all():
            return [(a, b) for a, b in zip(nodes.tolist(), label.tolist()) if a != b]
        label = new


def _lists_of(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows in order of list, and where each list begins."""
    rows = rows.sort_values(["key", "bi", "bj", "rid"], ignore_index=True)
    new = np.ones(len(rows) + 1, bool)
    for column in ("key", "bi", "bj"):
        values = rows[column].to_numpy()
        new[1:-1] = (new[1:-1] if column != "key" else False) | (values[1:] != values[:-1])
    return rows, np.flatnonzero(new)


def _pairs_ruled_in(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """The same bounds as ``may_be_similar`` for single pairs."""
    ok = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
    lengths = np.array([len(s) for s in sketches])
    for length in np.unique(lengths):
        at = np.flatnonzero(ok & (lengths[a] == length) & (lengths[b] == length))
        left, right = (
            np.frombuffer(b"".join(sketches[i] for i in x[at]), np.uint64).reshape(len(at), length // 8) for x in (a, b))
        ok[at] = np.bitwise_count(left ^ right).sum(1) <= (sizes[a[at]] + sizes[b[at]]) * (100 - percent) // (100 + percent)
    for i in np.flatnonzero(ok & (lengths[a] != lengths[b])):
        both = [a[i], b[i]]
        ok[i] = may_be_similar(sizes[both], [sketches[j] for j in both], percent)[0, 1]
    return ok


def _lists(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that sizes and parities allow: short lists by pairs, long ones as a forest."""
    rows, begin = _lists_of(rows)
    rid, sizes, sketches = rows["rid"].to_numpy(), rows["size"].to_numpy(), rows["sketch"].tolist()
    number = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    short = (np.diff(begin) <= SHORT_LIST)[number] if len(number) else np.zeros(0, bool)
    firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for apart in range(1, SHORT_LIST):
        at = np.flatnonzero(short[:-apart] & (number[:-apart] == number[apart:]))
        firsts.append(at)
        seconds.append(at + apart)
    a, b = np.concatenate(firsts), np.concatenate(seconds)
    once = np.unique(np.stack([rid[a], rid[b]], 1), axis=0, return_index=True)[1]
    a, b = a[once], b[once]
    ok = _pairs_ruled_in(a, b, sizes, sketches, percent)
    out = set(zip(rid[b[ok]].tolist(), rid[a[ok]].tolist()))
    for i in np.flatnonzero(np.diff(begin) > SHORT_LIST):
        part = slice(begin[i], begin[i + 1])
        out.update(_forest(rid[part], may_be_similar(sizes[part], sketches[part], percent)))
    return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")


def _verified(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Forests of the links of each group, compared by whole sets."""
    rows, begin = _lists_of(rows)
    rid, every, out = rows["rid"].to_numpy(), rows["set"].tolist(), []
    for start, stop in zip(begin[:-1], begin[1:]):
        nodes, sets = rid[start:stop], [np.frombuffer(s, np.uint64) for s in every[start:stop]]
        sizes = np.array([len(s) for s in sets])
        maybe = np.triu(may_be_similar(sizes, [sketch(s, percent) for s in sets], percent))
        root = list(range(len(nodes)))

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(*np.nonzero(maybe)):
            one, two = top(i), top(j)
            if one != two and similar(len(np.intersect1d(sets[i], sets[j], True)), sizes[i], sizes[j], percent):
                root[max(one, two)] = min(one, two)
        out += [(nodes[i], nodes[top(i)]) for i in range(len(nodes)) if top(i) != i]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _in_blocks(rows: DataFrame, counts: DataFrame, size: int, n_rows: int) -> DataFrame:
    """Rows (key, rid, ..) with the block pairs of their key, and the bucket in which a task takes them: small keys share
    one, a pair of blocks of a large key has its own."""
    buckets = max(1, n_rows // BUCKET)
    blocks = F.ceil(F.col("n") / size)
    own = F.pmod(F.xxhash64("rid"), F.col("blocks"))
    dealt = rows.join(counts.select("key", blocks.alias("blocks")), "key").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    bi, bj = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.withColumn("bi", bi).withColumn("bj", bj)
    return dealt.withColumn(
        "bucket", F.when(F.col("blocks") == 1, F.pmod("key", F.lit(buckets))).otherwise(F.xxhash64("key", "bi", "bj"))).drop(
        "blocks", "own", "other")


def joined(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): rid, doc_id, n_shingles, component_id.

    Sets of ``shingle`` words are linked from ``percent`` hundredths of similarity (50 to 99).

    component_id is the least doc_id of the rows that links reach; rows without words are linked with nothing. Null text has
    no words; a null doc_id takes part but is never the least; repeated rows are equal sets. Other columns are ignored.
    ``documents`` must give its rows in the same order each time it runs, as a scan does.
    """
    rows = numbered(documents.select("doc_id", "text"))
    keyed = saved(
        rows.select("rid", "doc_id", "text").mapInArrow(released(_set_keys(shingle)), "rid long, doc_id long, n_shingles long, key1 long, key2 long"),
        "sets",
    )
    identity = ["n_shingles", "key1", "key2"]
    distinct = saved(
        keyed.where("n_shingles > 0").groupBy(*identity).agg(F.min("rid").alias("node"), F.min("doc_id").alias("least_id")), "distinct-sets"
    )
    reps = distinct.where(F.col("n_shingles") >= least_size(percent)).select(F.col("node").alias("rid"), F.col("n_shingles").alias("size"))
    common, length = common_shingles(rows, keyed, shingle)
    edge = boundary(length, percent)
    sketched = saved(
        rows.select("rid", "text").mapInArrow(released(_keys(common, edge, shingle, percent)), "rid long, sketch binary, keys array<long>").join(reps, "rid"),
        "keys",
    )
    postings = sketched.select("rid", F.explode("keys").alias("key"))
    counts = saved(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    shared = saved(postings.join(counts.select("key"), "key"), "postings")
    # lists are dealt before the wide sketches are joined to them, so these are shuffled to their buckets once
    members = _in_blocks(shared, counts, LIST_BLOCK, shared.count()).join(sketched.drop("keys"), "rid")
    forest = members.groupBy("bucket").applyInPandas(lambda part: _lists(part, percent), "a long, b long")
    groups = saved(components(forest.distinct()).select(F.col("root").alias("key"), F.col("node").alias("rid")), "candidates")
    sizes = groups.groupBy("key").agg(F.count("*").alias("n"))
    removed(sketched, counts, shared)
    freed(documents.sparkSession)

    def sets(batches):
        for batch in batches:
            found, first = shingle_sets(batch["text"], shingle)
            yield pa.RecordBatch.from_arrays([
                batch["key"], batch["rid"],
                pa.array([found[first[i] : first[i + 1]].tobytes() for i in range(batch.num_rows)], pa.binary()),
            ], ["key", "rid", "set"])

    held, bits = bitmap_of(groups, "rid", MAX_BITS)

    def concerned(batches):
        hit = np.unpackbits(np.frombuffer(held.value, np.uint8)).view(bool)
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(hit, bits, batch["rid"].to_numpy())))

    texts = rows.select("rid", "text").mapInArrow(concerned, "rid long, text string").join(groups, "rid").select("key", "rid", "text")
    full = texts.mapInArrow(released(sets), "key long, rid long, set binary")
    links = _in_blocks(full, sizes, SET_BLOCK, 8 * groups.count()).groupBy("bucket").applyInPandas(lambda part: _verified(part, percent), "a long, b long")
    roots = components(saved(links, "links"))
    named = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    result = named.join(least, "root").select(*identity, "component_id", F.col("node").alias("kept"))
    return keyed.join(result, identity, "left").select(
        "rid", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op6(spark, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).drop("rid")


def one_of_each(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows of ``documents``, all columns, of which each component keeps the one with the least doc_id (of rows with the
    same doc_id, the first in order of the input). Rows without words and components without any doc_id are all kept."""
    found = saved(joined(documents, shingle, percent), "components").where("n_shingles > 0 AND component_id IS NOT NULL")
    first = found.where("doc_id = component_id").groupBy("component_id").agg(F.min("rid").alias("rid"))
    gone = found.join(first, "rid", "left_anti").select(F.col("rid").alias("__rid"))
    rows = numbered(documents, "__rid")
    return rows.join(gone, "__rid", "left_anti").drop("__rid")


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shingles AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(p.n) + any_value(q.n) - count(*))),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON r.other = p.a)
SELECT node AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes ON node = doc_id GROUP BY node
"""
