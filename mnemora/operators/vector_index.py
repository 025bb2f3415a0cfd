"""Exact search and similarity join over a stored coarse index of vectors.

A store of more than ``SEGMENT`` vectors is cut into cells around centres that are fitted on a bounded sample, and cells into
parts of about that size; a small store is one cell. Each part is a segment, one row: ids, filter columns, the vectors, and
the mean direction with the greatest angle to it. All vectors are written once, in folders by ``shard``, and shuffled once.

A search visits, for each query, the nearest cells that hold ``k`` vectors, takes the k-th best score, and then only the
cells whose angle to the query, less their own radius, still allows that score. Visits are joined to the segments on
(shard, segment), so scans read the shards that are visited; the vectors themselves stay where they lie. The bound is the
triangle inequality on angles, so the result is that of comparing everything.

The join of a store with itself takes the pairs of cells that the same inequality leaves. In a pair, the first dimensions after
a rotation that puts the variance first give an upper bound of every product (the rest adds at most the product of the rests'
lengths); only pairs above the limit are multiplied whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from . import blocks
from .ranking import top_n

SEGMENT = 8192         # vectors of a segment
SAMPLE = 8192          # vectors that the centres are fitted on
CENTRES = 256          # at most
ROUNDS = 6
BLOCK = 256            # queries that meet a segment at a time
SHARDS = 64            # folders of the stored segments at most
DIGITS = 6             # similarities are compared after rounding, so ties do not depend on summation order
SLACK = 2e-6           # of a bound, for that rounding
LEAD = 4               # the bound of a product takes one in so many dimensions


@dataclass
class VectorIndex:
    """``segments``: one row each; ``cells``: store, segment, shard, n, radius, centre."""

    segments: DataFrame
    cells: DataFrame


def unit_rows(column) -> np.ndarray:
    """List column as a matrix of unit rows; zero vectors stay zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def similarities(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.round(np.clip(queries @ vectors.T, -1.0, 1.0), DIGITS) + 0.0


def fitted_centres(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` unit centres of the rows, by a few rounds of means; deterministic."""
    centres = sample[np.random.default_rng(7).permutation(len(sample))[:n]]
    for _ in range(ROUNDS):
        home = (sample @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, home, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-300), centres)
    return centres


def _homes(centres):
    def run(batches):
        for batch in batches:
            home = (unit_rows(batch.column("embedding")) @ centres.value.T).argmax(axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32))], [*batch.schema.names, "cell"])

    return run


def _segment(rows: pa.Table) -> pa.Table:
    """One segment of its rows, in order of id. Zero vectors count as 90 degrees from everything."""
    rows = rows.sort_by("memory_id").combine_chunks()
    unit = unit_rows(rows.column("embedding"))
    mean = unit.sum(axis=0)
    norm = np.linalg.norm(mean)
    mean = mean / norm if norm > 0 else mean
    radius = float(np.arccos(np.clip(unit @ mean, -1, 1)).max())
    return pa.table({
        "shard": rows.column("shard").slice(0, 1), "segment": rows.column("segment").slice(0, 1), "store": rows.column("store").slice(0, 1),
        "n": pa.array([rows.num_rows], pa.int64()), "radius": pa.array([radius]), "centre": blocks.one(pa.array(mean)),
        "ids": blocks.one(rows.column("memory_id")), **{c: blocks.one(rows.column(c)) for c in blocks.ROW_FILTERS},
        "embeddings": blocks.one(rows.column("embedding"))})


def vector_index(vectors: DataFrame, path: str | None = None, segment: int = SEGMENT, most_centres: int = CENTRES) -> VectorIndex:
    """Index of ``vectors``: memory_id, embedding [, store, access_key, project_path, scope], of one length.

    Written below ``path``, from where ``read_index`` gets it again, or in the shared folder. Null vectors are left out; a null
    or missing store is the empty one.
    """
    spark = vectors.sparkSession
    own = [F.col(c) if c in vectors.columns else F.lit(None).cast("string").alias(c) for c in blocks.ROW_FILTERS]
    store = F.coalesce("store", F.lit("")) if "store" in vectors.columns else F.lit("")
    rows = vectors.filter(F.col("embedding").isNotNull()).select("memory_id", "embedding", store.alias("store"), *own)
    held = rows.select("memory_id", "embedding").orderBy(F.xxhash64("memory_id")).limit(SAMPLE).toArrow()
    n = rows.count() if held.num_rows == SAMPLE else held.num_rows
    centres = fitted_centres(unit_rows(held.column("embedding")), max(1, min(most_centres, -(-n // segment))))
    placed = rows.mapInArrow(_homes(spark.sparkContext.broadcast(centres)), T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))
    whole = F.sum("n").over(Window.partitionBy("store"))
    sizes = placed.groupBy("store", "cell").agg(F.count("*").alias("n")).select(
        "store", "cell", (whole <= segment).alias("small"), F.ceil(F.col("n") / segment).alias("parts"))
    shards = max(1, min(SHARDS, n // (8 * segment)))
    part = F.pmod(F.xxhash64("memory_id"), F.col("parts"))
    dealt = placed.join(sizes, ["store", "cell"]).withColumn(
        "segment", F.when(F.col("small"), F.xxhash64("store")).otherwise(F.xxhash64("store", "cell", part))).withColumn(
        "shard", F.pmod("segment", F.lit(shards)).cast("int")).select(*rows.columns, "segment", "shard")
    kinds = dict(rows.dtypes)
    made = dealt.groupBy("shard", "segment").applyInArrow(
        _segment, "shard int, segment bigint, store string, n bigint, radius double, centre array<double>, "
        f"ids array<{kinds['memory_id']}>, access_key array<string>, project_path array<string>, scope array<string>, "
        f"embeddings array<{kinds['embedding']}>")
    segments = stored(made, "segments", path, ["shard"])
    return VectorIndex(segments, segments.select("store", "segment", "shard", "n", "radius", "centre"))


def read_index(spark: SparkSession, path: str) -> VectorIndex:
    segments = spark.read.parquet(f"{path}/segments")
    return VectorIndex(segments, segments.select("store", "segment", "shard", "n", "radius", "centre"))


def _angles(queries: np.ndarray, cells: pa.Array) -> np.ndarray:
    """Least angle of each query to anything in each cell."""
    centre = np.stack(cells.field("centre").to_pylist())
    return np.arccos(np.clip(queries @ centre.T, -1, 1)) - cells.field("radius").to_numpy()


def _visits(k: int, kind: pa.DataType):
    """Per block of queries and store, the cells to visit: the nearest that hold ``k`` rows, or, where a query has a ``limit``,
    the others that may hold a score of that much."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asked, cells = batch.column("asked")[i].values, batch.column("cells")[i].values
                gap = _angles(unit_rows(asked.field("embedding")), cells)
                order = np.lexsort((np.broadcast_to(cells.field("segment").to_numpy(), gap.shape), gap), axis=1)
                held = np.take_along_axis(np.broadcast_to(cells.field("n").to_numpy(), gap.shape), order, 1)
                near = np.zeros(gap.shape, bool)
                np.put_along_axis(near, order, np.cumsum(held, axis=1) - held < k, 1)
                limit = asked.field("limit").to_numpy(zero_copy_only=False).astype(float)
                later = np.cos(np.clip(gap, 0, np.pi)) >= limit[:, None] - SLACK
                query, cell = np.nonzero(np.where(np.isnan(limit)[:, None], near, ~near & later))
                take = pa.array(cell)
                yield pa.RecordBatch.from_arrays(
                    [asked.field("query_id").take(pa.array(query)).cast(kind), cells.field("segment").take(take), cells.field("shard").take(take)],
                    ["query_id", "segment", "shard"])

    return run


def _best(k: int, least: float | None, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asked = pa.Table.from_batches([pa.RecordBatch.from_struct_array(batch.column("asked")[i].values)])
                ids = blocks.plain(batch.column("ids")[i].values)
                score = similarities(unit_rows(asked.column("embedding")), unit_rows(batch.column("embeddings")[i].values))
                seen = blocks.Access(asked).matrix({c: batch.column(c)[i].values for c in blocks.ROW_FILTERS})
                best = blocks.TopRows(len(score), k)
                for n, row in enumerate(score):
                    good = np.ones(len(row), bool) if seen is None else seen[n]
                    if least is not None:
                        good = good & (row >= least)
                    best.offer(n, row[good], ids[good])
                yield best.batch(asked.column("query_id"), schema)

    return run


def search_index(queries: DataFrame, index: VectorIndex, k: int, min_score: float | None = None) -> DataFrame:
    """(query_id, memory_id, score): the ``k`` most similar vectors of each query, cosine in [-1, 1], ties to the lower id.

    ``queries``: query_id, embedding [, stores, access_keys, project_path, scope, global_scope], ids distinct; without
    ``stores`` they search the empty store. With filter columns a query sees only rows that pass them.
    """
    filters = [c for c in blocks.QUERY_FILTERS if c in queries.columns]
    asked = queries.filter(F.col("embedding").isNotNull()).select(
        "query_id", "embedding", (F.array_distinct("stores") if "stores" in queries.columns else F.array(F.lit(""))).alias("stores"), *filters)
    n_blocks = max(1, -(-asked.count() // BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    cells = index.cells.groupBy("store").agg(F.collect_list(F.struct("segment", "shard", "n", "radius", "centre")).alias("cells"))
    kind = blocks.ARROW[dict(asked.dtypes)["query_id"]]
    out = T.StructType([
        T.StructField("query_id", asked.schema["query_id"].dataType),
        T.StructField("memory_id", index.segments.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])

    def visited(limited: DataFrame) -> DataFrame:
        """Hits in the cells that ``limited`` (query_id, limit) has to visit."""
        told = asked.select("query_id", "embedding", "stores").join(limited, "query_id").select(
            "query_id", "embedding", "limit", F.explode("stores").alias("store"))
        packed = told.groupBy("store", block.alias("block")).agg(F.collect_list(F.struct("query_id", "embedding", "limit")).alias("asked"))
        visits = packed.join(cells, "store").mapInArrow(
            _visits(k, kind), f"query_id {dict(asked.dtypes)['query_id']}, segment bigint, shard int")
        dealt = stored(visits.join(asked.drop("stores"), "query_id").groupBy("shard", "segment", block.alias("block")).agg(
            F.collect_list(F.struct("query_id", "embedding", *filters)).alias("asked")).drop("block"), "visits")
        hits = index.segments.select("shard", "segment", "ids", *blocks.ROW_FILTERS, "embeddings").join(
            dealt, ["shard", "segment"]).mapInArrow(_best(k, min_score, blocks.arrow_schema(out)), out)
        return top_n(hits, ["query_id"], [F.desc("score"), F.col("memory_id")], k)

    first = stored(visited(asked.select("query_id", F.lit(None).cast("double").alias("limit"))), "first")
    lowest = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    floor = -2.0 if min_score is None else float(min_score)
    limits = asked.select("query_id").join(lowest, "query_id", "left").select(
        "query_id", F.when(F.col("n") >= k, F.col("low")).otherwise(floor).alias("limit"))
    return top_n(first.unionByName(visited(limits)), ["query_id"], [F.desc("score"), F.col("memory_id")], k)


class Pairs:
    """Similar rows of two matrices of unit rows. ``whole`` counts the pairs that were multiplied in all dimensions."""

    def __init__(self, left: np.ndarray, right: np.ndarray, least: float):
        both = np.concatenate([left, right])
        turn = np.linalg.eigh(both.T @ both)[1][:, ::-1]
        self.left, self.right, self.least, self.whole = left, right, least, 0
        self.turned = left @ turn, right @ turn
        self.rests = [np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], 0)) for x in self.turned]

    def _products(self, a, b, left, right) -> np.ndarray:
        out, step = np.empty(len(a)), max(1, (1 << 21) // left.shape[1])
        for i in range(0, len(a), step):
            part = slice(i, i + step)
            out[part] = np.einsum("ij,ij->i", left[a[part]], right[b[part]])
        return out

    def found(self, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row in ``left``, row in ``right`` and similarity of all pairs of the ``rows`` of at least ``least``.

        A lead of the rotated dimensions bounds every product; pairs that it leaves are tested by leads of twice the size. Where
        the first leaves more than one pair in eight, whole products are cheaper.
        """
        (x, y), (p, q), limit = self.turned, self.rests, self.least - SLACK
        x, p, lead = x[rows], p[rows], max(1, x.shape[1] // LEAD)
        last = np.zeros((0, 0)) if lead >= x.shape[1] else np.outer(p[:, lead], q[:, lead])
        a, b = np.nonzero(x[:, :lead] @ y[:, :lead].T + (last if last.size else 0) >= limit)
        if 8 * len(a) > len(x) * len(y):
            self.whole += len(x) * len(y)
            score = similarities(self.left[rows], self.right)
            a, b = np.nonzero(score >= self.least)
            return a + (rows.start or 0), b, score[a, b]
        while 2 * lead < x.shape[1] and len(a):
            lead *= 2
            bound = self._products(a, b, x[:, :lead], y[:, :lead]) + p[a, lead] * q[b, lead]
            a, b = a[bound >= limit], b[bound >= limit]
        self.whole += len(a)
        score = np.round(np.clip(self._products(a, b, self.left[rows], self.right), -1.0, 1.0), DIGITS) + 0.0
        good = score >= self.least
        return a[good] + (rows.start or 0), b[good], score[good]


def _cell_pairs(reach: float):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cells = batch.column("cells")[i].values
                centre = np.asarray([batch.column("centre")[i].as_py()])
                gap = _angles(centre, cells)[0] - batch.column("radius")[i].as_py()
                take = pa.array(np.flatnonzero(gap <= reach))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("segment").slice(i, 1).take(pa.array(np.zeros(len(take), int))), batch.column("shard").slice(i, 1).take(
                        pa.array(np.zeros(len(take), int))), cells.field("segment").take(take), cells.field("shard").take(take)],
                    ["segment", "shard", "other", "other_shard"])

    return run


def _joined(k: int, least: float, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, others = (batch.column(c)[i].values for c in ("ids", "other_ids"))
                names = blocks.plain(others)
                pairs = Pairs(*(unit_rows(batch.column(c)[i].values) for c in ("embeddings", "other_embeddings")), least)
                for start in range(0, len(ids), BLOCK):
                    a, b, score = pairs.found(slice(start, start + BLOCK))
                    order = np.lexsort((names[b], -score, a))
                    a, b, score = a[order], b[order], score[order]
                    first = np.arange(len(a)) - np.searchsorted(a, a) < k
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(a[first])), others.take(pa.array(b[first])), pa.array(score[first])], schema=schema)

    return run


def neighbours(index: VectorIndex, k: int, least: float) -> DataFrame:
    """(memory_id, neighbour_id, score): the ``k`` most similar vectors of each vector's store, itself among them, of ``least`` or
    more."""
    cells = index.cells.groupBy("store").agg(F.collect_list(F.struct("segment", "shard", "n", "radius", "centre")).alias("cells"))
    reach = float(np.arccos(np.clip(least - SLACK, -1, 1))) + 1e-9
    pairs = index.cells.join(cells, "store").mapInArrow(_cell_pairs(reach), "segment bigint, shard int, other bigint, other_shard int")
    mine = index.segments.select("shard", "segment", "ids", "embeddings")
    theirs = mine.toDF("other_shard", "other", "other_ids", "other_embeddings")
    kind = index.segments.schema["ids"].dataType.elementType
    out = T.StructType([T.StructField("memory_id", kind), T.StructField("neighbour_id", kind), T.StructField("score", T.DoubleType())])
    met = stored(pairs, "pairs").join(mine, ["shard", "segment"]).join(theirs, ["other_shard", "other"])
    found = met.select("ids", "embeddings", "other_ids", "other_embeddings").mapInArrow(_joined(k, least, blocks.arrow_schema(out)), out)
    return top_n(found, ["memory_id"], [F.desc("score"), F.col("neighbour_id")], k)
