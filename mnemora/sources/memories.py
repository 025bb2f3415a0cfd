"""Stored tables: memories with JSON text columns, sessions, recall, spaces, and memory exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import JSON_COLUMNS, MEMORY_DEFAULTS


def decode_memories(raw: DataFrame) -> DataFrame:
    """JSON text columns become typed (bad or missing text: empty list, no provenance); missing columns get defaults.

    Provenance fields that joins need are also put next to the struct.
    """
    decoded = raw
    for name, kind in JSON_COLUMNS.items():
        text = F.col(name) if name in raw.columns else F.lit(None).cast("string")
        value = F.from_json(text, kind)
        if name != "provenance":
            value = F.coalesce(value, F.array().cast(kind))
        decoded = decoded.withColumn(name, value)
    for name, (kind, value) in MEMORY_DEFAULTS.items():
        stored = F.col(name).cast(kind) if name in raw.columns else F.lit(None).cast(kind)
        decoded = decoded.withColumn(name, F.coalesce(stored, F.lit(value).cast(kind)))
    for name in ("created_at", "updated_at", "last_accessed_at"):
        if name in raw.columns and dict(raw.dtypes)[name] == "string":
            decoded = decoded.withColumn(name, F.try_to_timestamp(F.col(name)))
    for field in ("shared_from_memory", "shared_from_space", "shared_by_user", "source_version"):
        decoded = decoded.withColumn(field, F.col("provenance")[field])
    return decoded


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    return decode_memories(spark.read.parquet(path))


def write_memories(memories: DataFrame, path: str) -> None:
    """Partitioned by space; vectors belong into a table of their own, so scans of texts do not read them."""
    memories.write.mode("overwrite").partitionBy("space_id").parquet(path)


SESSION_SCHEMA = "session_id string, conv_id bigint, turn bigint, role string, content string, agent_id string, created_s bigint"


def read_sessions(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(SESSION_SCHEMA).parquet(path)


def session_of(messages: DataFrame, session_id: str) -> DataFrame:
    return messages.filter(F.col("session_id") == session_id)


def read_recall(spark: SparkSession, events_path: str, items_path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(events_path), spark.read.parquet(items_path)


SPACE_JSON = (
    "id string, space_type string, name string, owner_id string, "
    "members array<struct<user_id:string,role:string,joined_at:string>>, "
    "auto_share_rules array<struct<id:string,source_space:string,categories:array<string>,tags:array<string>,"
    "min_importance:double,require_approval:boolean,created_at:string>>"
)


def flatten_spaces(blobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spaces, members, rules) of space blobs. ``blobs``: data (JSON text)."""
    rows = blobs.select(F.from_json("data", SPACE_JSON).alias("s")).select("s.*")
    spaces = rows.select(
        F.col("id").alias("space_id"), "space_type", "name", "owner_id",
        F.coalesce(F.size("members"), F.lit(0)).alias("n_members"))
    members = rows.select(F.col("id").alias("space_id"), F.inline("members"))
    rules = rows.select(F.col("id").alias("_space"), F.posexplode("auto_share_rules").alias("position", "_rule")).select(
        F.col("_space").alias("space_id"), "position", F.col("_rule.id").alias("rule_id"), "_rule.source_space",
        "_rule.categories", "_rule.tags", "_rule.min_importance", "_rule.require_approval")
    return spaces, members, rules


EXPORT_FIELDS = "id:string,content:string,category:string,tenant_id:string,space_id:string,agent_id:string,importance:double"


def import_json(files: DataFrame, tenant_id: str, space_id: str, agent_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(memories, counts per file) of exports. ``files``: file_name, text, either ``[..]`` or ``{"memories": [..]}``.

    Tenant and space are overruled, a missing agent is filled. Entries without id or content cannot be stored and
    count as skipped; a text that is neither form gives no rows.
    """
    listed = F.startswith(F.trim("text"), F.lit("["))
    array = F.from_json("text", f"array<struct<{EXPORT_FIELDS}>>")
    wrapped = F.from_json("text", f"memories array<struct<{EXPORT_FIELDS}>>")["memories"]
    entries = files.select("file_name", F.inline_outer(F.when(listed, array).otherwise(wrapped)))
    good = F.col("id").isNotNull() & F.col("content").isNotNull()
    rows = entries.filter(good).withColumn("tenant_id", F.lit(tenant_id)).withColumn("space_id", F.lit(space_id)).withColumn(
        "agent_id", F.coalesce("agent_id", F.lit(agent_id)))
    some = F.coalesce("id", "content", "category", "tenant_id", "space_id", "agent_id").isNotNull()
    counts = entries.groupBy("file_name").agg(
        F.count_if(some).alias("total"), F.count_if(good).alias("stored"), F.count_if(some & ~good).alias("skipped"))
    return rows, counts


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (file_name, text) for ``import_json``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


