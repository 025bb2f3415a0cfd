"""Streaming versions of ingest, counters, sharing and statistics."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import session_memory, sharing, stats, updates
from ..operators.graph import with_hash
from ..operators.ranking import top_n
from ..session import shared_folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a sink or checkpoint in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, folder: str, table: str, like: DataFrame) -> DataFrame:
    """File stream over the parquet files of one table, which is a file or a folder of files.

    The path is a pattern, as Spark takes a plain one for the folder that partition columns lie below, and a file is none.
    """
    return spark.readStream.schema(like.schema).parquet(f"{folder}/{table}.parque[t]")


def stream_dedup_messages(messages: DataFrame, within: str = "1 day") -> DataFrame:
    """First message of each content hash within the watermark. ``messages`` carry a timestamp ``created_at``."""
    return with_hash(messages).withWatermark("created_at", within).dropDuplicatesWithinWatermark(["content_hash"])


def append_new_messages(store: str):
    """``foreachBatch`` body of the exact form: only messages whose hash no earlier batch has stored, whatever their age.

    They go to ``store`` under the number of the batch, so a batch that runs again replaces itself.
    """
    def of_batch(messages: DataFrame, number: int) -> DataFrame:
        spark = messages.sparkSession
        fresh = with_hash(messages).dropDuplicates(["content_hash"])
        if number:
            known = spark.read.schema("content_hash string, batch int").parquet(store).filter(F.col("batch") < number)
            fresh = fresh.join(known.select("content_hash").distinct(), "content_hash", "left_anti")
        path = f"{store}/batch={number}"
        fresh.write.mode("overwrite").parquet(path)
        return spark.read.schema(fresh.schema).parquet(path)

    return of_batch


def stream_access_counts(hits: DataFrame) -> DataFrame:
    """Running hits per memory (update mode); feed batches to ``updates.bump_access`` by ``foreachBatch``."""
    return hits.groupBy("id").agg(F.count("*").alias("hits"))


def apply_access_batch(memories: DataFrame, batch: DataFrame, as_of) -> DataFrame:
    return updates.bump_access(memories, batch, as_of)


def stream_auto_share(memories: DataFrame, spaces: DataFrame, members: DataFrame, rules: DataFrame, stored: DataFrame, as_of):
    """``foreachBatch`` body: copies of the new memories that rules ask for, as a DataFrame for the sink."""
    def of_batch(batch: DataFrame, number: int) -> DataFrame:
        return sharing.auto_share(batch, spaces, members, rules, as_of, stored)

    return of_batch


def session_state(memories: DataFrame, log: str, before: int) -> DataFrame:
    """Session memories as the batches below ``before`` left them: the last row of each id in the log, else the stored one."""
    if before == 0:
        return memories.withColumn("place", F.lit(-1).cast("bigint"))
    logged = memories.sparkSession.read.parquet(log).filter(F.col("batch") < before)
    last = top_n(logged, ["id"], [F.desc("batch")], 1)
    kept = memories.withColumn("id", F.col("id").cast("string")).join(last.select("id"), "id", "left_anti")
    return kept.withColumn("place", F.lit(-1).cast("bigint")).unionByName(
        last.withColumn("created_at", F.lit(None).cast("timestamp")).select(*memories.columns, "place"))


def stream_session_memory(memories: DataFrame, as_of, log: str):
    """``foreachBatch`` body: a batch of topics folded onto the session memories as the batches before it left them. It reads the
    log of all batches; ``keyed_session_memory`` does not.

    Changed rows go to ``log`` under the number of the batch, so a batch that runs again replaces itself.
    """
    def of_batch(topics: DataFrame, number: int) -> DataFrame:
        path = f"{log}/batch={number}"
        session_memory.append_topics(session_state(memories, log, number), topics, as_of).write.mode("overwrite").parquet(path)
        return memories.sparkSession.read.parquet(path)

    return of_batch


OPEN_ROW = "id string, content string, l0_abstract string, tags array<string>, parent_id string, place bigint"


class SessionFold(StatefulProcessor):
    """Keeps the open memory of each kind of one session; topics are folded onto it as they come."""

    def __init__(self, max_tags: int | None):
        self.max_tags = max_tags

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "kind string", OPEN_ROW)

    def _keep(self, row: dict) -> None:
        tags = list(row["tags"])[: self.max_tags]
        self.open.updateValue((row["kind"],), (row["id"], row["content"], row["l0_abstract"], tags, row["parent_id"], int(row["place"])))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.to_dict("records"):
            self._keep(row)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        topics = [r for frame in rows for r in frame.to_dict("records")]
        names = [part.split()[0] for part in OPEN_ROW.split(", ")]
        held = [{"session_id": key[0], "kind": kind[0], **dict(zip(names, value))} for kind, value in self.open.iterator()]
        made = session_memory.folded_rows(held, sorted(topics, key=lambda r: r["topic_no"]))
        newest = {}
        for row in sorted(made.to_dict("records"), key=lambda r: r["place"]):
            newest[row["kind"]] = row
        for row in newest.values():
            self._keep(row)
        yield made

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed state needs."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def keyed_session_memory(topics: DataFrame, memories: DataFrame, as_of, max_tags: int | None = 8) -> DataFrame:
    """Changed and new memories (see ``session_memory.append_topics``) of a stream of topics.

    The state of a session is its open memory of each kind, at first the stored one of ``memories``, so the cost of a batch
    depends on its topics only. A memory comes out once for each batch that changes it; the last row of an id stands.
    """
    rows = session_memory.incoming(topics, as_of)
    first = session_memory.open_rows(memories).withColumn("parent_id", F.lit(None).cast("string")).select(
        "session_id", "kind", *[p.split()[0] for p in OPEN_ROW.split(", ")])
    folded = rows.groupBy("session_id").transformWithStateInPandas(
        SessionFold(max_tags), session_memory.FOLDED_SCHEMA, "append", "None", initialState=first.groupBy("session_id"))
    return session_memory.finished(folded, max_tags)


def stream_timeline(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per event-time day and action; days close one day behind the newest event."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "action").agg(
        F.count("*").alias("n")).select(F.col("day.start").alias("day"), "action", "n")


def stream_session_groups(events: DataFrame) -> DataFrame:
    """Recall groups per session, kept up to date (update or complete mode)."""
    return stats.session_groups(events)


def drain(stream: DataFrame, mode: str, fn=None, folder: str | None = None) -> DataFrame:
    """Process what a stream's source holds now and give the result as a table.

    ``fn`` maps each micro-batch and its number. In complete mode the state behind the last batch stands; in the other modes the
    rows of all batches. ``folder`` keeps sink and checkpoint, so a later call goes on from there.
    """
    spark = stream.sparkSession
    folder = folder or work_folder(spark, "drained")
    out, check = f"{folder}/sink", f"{folder}/checkpoint"
    schema = None

    def write(batch: DataFrame, number: int) -> None:
        nonlocal schema
        rows = fn(batch, number) if fn else batch
        schema = rows.schema
        rows.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", check).trigger(
        availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    whole = T.StructType([*(schema.fields if schema else stream.schema.fields), T.StructField("_batch", T.IntegerType())])
    done = spark.read.schema(whole).parquet(out)
    if mode == "complete":
        done = done.filter(F.col("_batch") == done.agg(F.max("_batch")).first()[0])
    return done.drop("_batch", "part")
