"""Rules that depend on order: the recall gate and the noise learner, over tables and over streams.

**Recall gate.** Whether a request passes depends only on the time of the last one that passed, and of equal times only the first
request can pass. A key's distinct seconds are cut into chunks of ``CHUNK_S``; a chunk is a function from the last pass before
it to the last pass in it, known from the few seconds where a first pass can lie: those near the start of the chunk, and those
up to an interval behind the pass that an earlier batch left within it. Chunks of one key become such
functions in parallel, a walk over these summaries gives the last pass before every chunk, and chunks find their passes in
parallel again. A key with a third of all rows is spread like any other.

**Noise learner.** Leaders depend on all earlier ones, so a tenant is one sequence; it is taken block by block: one matrix product
of a block with the known leaders, then steps only at the rows that become leaders.

Streams run the same operators on each micro-batch (``foreachBatch``), with the state of all keys in a table by number of the
batch: a batch reads what the one before it left, and one that runs again replaces its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import top_n
from ..operators.vector_index import unit_rows
from ..session import stored

INTERVAL_S = 30
FORGET_S = 86_400
SAME_QUERY = 0.7
SAME_NOISE = 0.95
LEARNED = 200
CHUNK_S = 3600
BLOCK = 1024
DIGITS = 6

GATE_STATE = "gate_key string, last bigint"
NOISE_STATE = "tenant_id string, seq bigint, embedding array<double>"


def gate_key():
    """Tenant and session, or the tenant alone where there is no session."""
    session = F.coalesce("session_id", F.lit(""))
    return F.when(session == "", F.col("tenant_id")).otherwise(F.concat("tenant_id", F.lit(":"), session))


def gate_rows(queries: DataFrame) -> DataFrame:
    """``queries``: tenant_id, session_id, query_id, ts, similarity (to the client's previous query, may be null)."""
    return queries.select(
        gate_key().alias("gate_key"), "query_id", F.unix_seconds("ts").alias("ts_s"), F.col("similarity").cast("double").alias("similarity"))


def judge(last: int | None, ts: int, similarity: float | None) -> tuple[int | None, str]:
    """(time of the last request let through the rate limit, reason), row by row. A similar query uses up its slot anyway."""
    if last is not None and ts - last >= FORGET_S:
        last = None
    if last is not None and ts - last < INTERVAL_S:
        return last, "rate_limited"
    if similarity is not None and similarity == similarity and similarity > SAME_QUERY:
        return ts, "similarity_too_high"
    return ts, "ok"


def chunk_function(ts: np.ndarray, known: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Seconds of a chunk that may be its first pass, and the last pass that follows from each. ``ts``: sorted, distinct;
    ``known``: the pass that an earlier batch left, which may lie within the chunk."""
    after = np.searchsorted(ts, ts + INTERVAL_S)
    last = np.where(after < len(ts), after, np.arange(len(ts)))
    while (last[last] != last).any():
        last = last[last]
    begins = int(ts[0] - ts[0] % CHUNK_S)
    first = int(np.searchsorted(ts, max(begins, begins if known is None else known) + INTERVAL_S)) + 1
    return ts[:first], ts[last[:first]]


def chunk_passes(ts: np.ndarray, last: int | None) -> list[int]:
    """Seconds of a chunk at which a request passes, given the last pass before it."""
    out, at = [], 0 if last is None else int(np.searchsorted(ts, last + INTERVAL_S))
    while at < len(ts):
        out.append(int(ts[at]))
        at = int(np.searchsorted(ts, ts[at] + INTERVAL_S))
    return out


def _summaries(batches):
    for batch in batches:
        made = [chunk_function(np.asarray(x), known) for x, known in zip(batch.column("ts").to_pylist(), batch.column("known").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("gate_key"), batch.column("chunk"), *[pa.array([m[i].tolist() for m in made], pa.list_(pa.int64())) for i in (0, 1)],
             batch.column("known")], ["gate_key", "chunk", "first", "last", "known"])


def _walk(batches: Iterator[pa.RecordBatch]):
    """Last pass before each chunk, over summaries in order of key and chunk."""
    key, last = None, None
    for batch in batches:
        before = []
        for name, first, ends, known in zip(*(batch.column(c).to_pylist() for c in ("gate_key", "first", "last", "known"))):
            if name != key:
                key, last = name, known
            before.append(last)
            at = 0 if last is None else int(np.searchsorted(first, last + INTERVAL_S))
            if at < len(first):
                last = ends[at]
        yield pa.RecordBatch.from_arrays(
            [batch.column("gate_key"), batch.column("chunk"), pa.array(before, pa.int64())], ["gate_key", "chunk", "before"])


def _pass_times(batches):
    for batch in batches:
        found = [chunk_passes(np.asarray(ts), last) for ts, last in zip(batch.column("ts").to_pylist(), batch.column("before").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("gate_key"), pa.array(found, pa.list_(pa.int64()))], ["gate_key", "passes"])


def gated(rows: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts, state behind them) of ``gate_rows``; ``state``: gate_key, last pass of what came before.

    A request within ``INTERVAL_S`` of the last pass, or before it, is rate-limited; another one passes the limit, but is
    refused if its similarity is above ``SAME_QUERY``. Equal times go by query_id. Null similarities are not similar.
    """
    spark = rows.sparkSession
    seconds = rows.groupBy("gate_key", "ts_s").agg(F.min("query_id").alias("query_id"))
    known = spark.createDataFrame([], GATE_STATE) if state is None else state
    chunks = stored(seconds.groupBy("gate_key", F.floor(F.col("ts_s") / CHUNK_S).alias("chunk")).agg(
        F.sort_array(F.collect_list("ts_s")).alias("ts")).join(known.withColumnRenamed("last", "known"), "gate_key", "left"), "chunks")
    summaries = chunks.mapInArrow(_summaries, "gate_key string, chunk bigint, first array<bigint>, last array<bigint>, known bigint")
    before = summaries.repartition("gate_key").sortWithinPartitions("gate_key", "chunk").mapInArrow(
        _walk, "gate_key string, chunk bigint, before bigint")
    times = stored(chunks.join(before, ["gate_key", "chunk"]).mapInArrow(_pass_times, "gate_key string, passes array<bigint>"), "passes")
    passes = times.select("gate_key", F.explode("passes").alias("ts_s"))
    firsts = passes.join(seconds, ["gate_key", "ts_s"]).select("gate_key", "ts_s", "query_id", F.lit(True).alias("passed"))
    reason = F.when(F.col("passed").isNull(), "rate_limited").when(
        ~F.isnan("similarity") & (F.col("similarity") > SAME_QUERY), "similarity_too_high").otherwise("ok")
    verdicts = rows.join(firsts, ["gate_key", "ts_s", "query_id"], "left").withColumn("reason", reason).select(
        "gate_key", "query_id", "ts_s", (F.col("reason") == "ok").alias("allowed"), "reason")
    latest = times.groupBy("gate_key").agg(F.max(F.array_max("passes")).alias("last")).filter("last IS NOT NULL")
    return verdicts, known.join(latest, "gate_key", "left_anti").unionByName(latest)


def recall_gate_batch(queries: DataFrame) -> DataFrame:
    return gated(gate_rows(queries))[0]


def _state_before(spark: SparkSession, folder: str, number: int, schema: str) -> DataFrame | None:
    """What the batch before ``number`` left: each batch writes the state of all keys, so none reads more than one."""
    return None if number == 0 else spark.read.schema(schema).parquet(f"{folder}/batch={number - 1}")


def recall_gate(folder: str):
    """``foreachBatch`` body of a stream of queries: verdicts of a batch, after those of the batches before it.

    The last pass of each key goes to ``folder`` under the number of the batch; one that is ``FORGET_S`` behind the newest
    no longer counts and is left out.
    """
    def of_batch(queries: DataFrame, number: int) -> DataFrame:
        rows = stored(gate_rows(queries), "requests")
        verdicts, state = gated(rows, _state_before(rows.sparkSession, folder, number, GATE_STATE))
        newest = rows.agg(F.max("ts_s")).first()[0]
        state.filter(F.col("last") > F.lit(newest) - FORGET_S).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        return verdicts

    return of_batch


def unit(vector) -> np.ndarray:
    array = np.asarray(vector, dtype=float)
    norm = np.linalg.norm(array)
    return array / norm if norm else array


class Leaders:
    """Learned vectors of one tenant, oldest first, at most ``size``; the oldest leaves for a new one."""

    def __init__(self, fixed: np.ndarray, size: int, same: float, learned=()):
        self.fixed, self.size, self.same, self.learned = fixed, size, same, list(learned)

    def learn(self, vectors: np.ndarray) -> np.ndarray:
        """Which rows join, in order: those close to no fixed and no learned vector."""
        out = np.zeros(len(vectors), bool)
        for start in range(0, len(vectors), BLOCK):
            self._block(vectors[start : start + BLOCK], out[start : start + BLOCK])
        return out

    def _block(self, rows: np.ndarray, out: np.ndarray) -> None:
        gone, held = 0, len(self.learned)
        youngest = np.full(len(rows), -1)  # place of the newest leader that a row is close to: the last of its leaders to leave
        if held:
            close = np.round(rows @ np.stack(self.learned).T, DIGITS) >= self.same
            youngest = np.where(close.any(axis=1), held - 1 - close[:, ::-1].argmax(axis=1), -1)
        if len(self.fixed):  # never leave
            youngest[(np.round(rows @ self.fixed.T, DIGITS) >= self.same).any(axis=1)] = np.iinfo(np.int64).max
        at = 0
        while True:
            free = np.flatnonzero(youngest[at:] < gone)
            if not len(free):
                return
            at += int(free[0])
            out[at] = True
            if len(self.learned) >= self.size:
                self.learned.pop(0)
                gone += 1
            self.learned.append(rows[at])
            close = at + 1 + np.flatnonzero(np.round(rows[at + 1 :] @ rows[at], DIGITS) >= self.same)
            youngest[close] = np.maximum(youngest[close], held)
            held += 1
            at += 1


def _taught(fixed: np.ndarray, same: float, size: int):
    """Rows in order of tenant, state first, then seq: which of the new ones join."""

    def run(batches: Iterator[pa.RecordBatch]):
        tenant, leaders = None, None
        for batch in batches:
            names, old = batch.column("tenant_id").to_pylist(), batch.column("old").to_numpy(zero_copy_only=False)
            learned, start = np.zeros(len(names), bool), 0
            vectors = unit_rows(batch.column("embedding"))
            while start < len(names):
                stop = start
                while stop < len(names) and names[stop] == names[start] and old[stop] == old[start]:
                    stop += 1
                if leaders is None or names[start] != tenant:
                    tenant, leaders = names[start], Leaders(fixed, size, same)
                if old[start]:
                    leaders.learned.extend(vectors[start:stop])
                else:
                    learned[start:stop] = leaders.learn(vectors[start:stop])
                start = stop
            yield pa.RecordBatch.from_arrays(
                [batch.column("tenant_id"), batch.column("seq"), pa.array(learned)], ["tenant_id", "seq", "learned"]).filter(pa.array(~old))

    return run


def learned_noise(rejected: DataFrame, prototypes: list, state: DataFrame | None = None, same: float = SAME_NOISE,
                  size: int = LEARNED) -> tuple[DataFrame, DataFrame]:
    """((tenant_id, seq, learned), state behind them) of rejected vectors in order of seq, which is distinct within a tenant.

    ``prototypes``: the fixed vectors, as lists. ``state``: tenant_id, seq, embedding of the learned ones of before.
    """
    rows = rejected.select("tenant_id", "seq", F.col("embedding").cast("array<double>").alias("embedding"))
    before = rejected.sparkSession.createDataFrame([], NOISE_STATE) if state is None else state
    both = rows.withColumn("old", F.lit(False)).unionByName(before.withColumn("old", F.lit(True)))
    fixed = np.stack([unit(p) for p in prototypes]) if len(prototypes) else np.zeros((0, 1))
    told = stored(both.repartition("tenant_id").sortWithinPartitions("tenant_id", F.desc("old"), "seq").mapInArrow(
        _taught(fixed, same, size), "tenant_id string, seq bigint, learned boolean"), "learned")
    joined = rows.join(told.filter("learned").select("tenant_id", "seq"), ["tenant_id", "seq"]).select("tenant_id", "seq", "embedding")
    return told, top_n(before.unionByName(joined), ["tenant_id"], [F.desc("seq")], size)


def noise_learner_batch(rejected: DataFrame, prototypes: list, same: float = SAME_NOISE, size: int = LEARNED) -> DataFrame:
    """(tenant_id, seq, learned) of rejected vectors."""
    return learned_noise(rejected, prototypes, None, same, size)[0]


def noise_learner(folder: str, prototypes: list, same: float = SAME_NOISE, size: int = LEARNED):
    """``foreachBatch`` body of a stream of rejected vectors, whose batches come in order of seq. The learned vectors go to ``folder``
    under the number of the batch."""
    def of_batch(rejected: DataFrame, number: int) -> DataFrame:
        rows = stored(rejected.select("tenant_id", "seq", "embedding"), "rejected")
        told, state = learned_noise(rows, prototypes, _state_before(rows.sparkSession, folder, number, NOISE_STATE), same, size)
        state.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        return told

    return of_batch
