"""Copies of memories between spaces, their events and their upkeep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times
from . import graph
from .ranking import top_n


def copy_id(source: Column, space: Column) -> Column:
    return F.sha2(F.concat_ws("/", F.lit("copy"), source.cast("string"), space), 256)


def shared_copy(rows: DataFrame, as_of, visibility: str = "global") -> DataFrame:
    """Copies of memories for ``target_space``: fresh id, counters, times and provenance; project and history cleared.

    ``rows``: memory columns plus target_space, user_id, agent_id.
    """
    stamp = times.moment(as_of)
    changed = {
        "id": copy_id(F.col("id"), F.col("target_space")),
        "shared_from_memory": F.col("id"), "shared_from_space": F.col("space_id"), "shared_by_user": F.col("user_id"),
        "shared_by_agent": F.col("agent_id"), "shared_at": stamp, "original_created_at": F.col("created_at"),
        "source_version": F.col("version"), "space_id": F.col("target_space"), "visibility": F.lit(visibility),
        "access_count": F.lit(0), "version": F.lit(1).cast("bigint"), "created_at": stamp, "updated_at": stamp,
    }
    cleared = ("superseded_by", "invalidated_at", "last_accessed_at", "tier_history", "cluster_id", "metadata", "project_path")
    for name in cleared:
        if name in rows.columns:
            changed[name] = F.lit(None).cast(rows.schema[name].dataType)
    kept = [c for c in rows.columns if c not in changed and c not in ("target_space", "user_id")]
    return rows.select(*kept, *[value.alias(name) for name, value in changed.items()])


def copied_vectors(copies: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of the copies: those of their sources."""
    return copies.select("id", F.col("shared_from_memory").alias("_source")).join(
        vectors.withColumnRenamed("id", "_source"), "_source").drop("_source")


@dataclass
class Shared:
    copies: DataFrame
    results: DataFrame
    events: DataFrame


def share_events(rows: DataFrame, action: str, as_of) -> DataFrame:
    """Event rows. ``rows``: memory_id, from_space, to_space, user_id, agent_id, content."""
    key = F.concat_ws("/", F.lit(action), F.col("memory_id").cast("string"), "to_space", "user_id")
    return rows.select(
        F.sha2(key, 256).alias("id"), F.lit(action).alias("action"), "memory_id", "from_space", "to_space", "user_id",
        "agent_id", tx.preview(F.col("content")).alias("content_preview"), times.moment(as_of).alias("ts"))


def share(requests: DataFrame, memories: DataFrame, as_of, action: str = "batch_share", visibility: str = "global") -> Shared:
    """``requests``: memory_id, target_space, user_id, agent_id. A copy that exists is returned instead of a new one.

    One request per (memory, space) counts; the result says shared, existing or not_found.
    """
    asked = top_n(requests, ["memory_id", "target_space"], [F.col("user_id"), F.col("agent_id")], 1)
    copies = memories.filter(F.col("shared_from_memory").isNotNull()).groupBy(
        F.col("shared_from_memory").alias("memory_id"), F.col("space_id").alias("target_space")).agg(F.min("id").alias("existing_id"))
    judged = asked.join(copies, ["memory_id", "target_space"], "left").join(
        memories.select(F.col("id").alias("memory_id"), F.lit(True).alias("_found")), "memory_id", "left")
    status = (F.when(F.col("_found").isNull(), F.lit("not_found"))
              .when(F.col("existing_id").isNotNull(), F.lit("existing")).otherwise(F.lit("shared")))
    results = judged.withColumn("status", status).drop("_found")
    new = results.filter("status = 'shared'").select(F.col("memory_id").alias("id"), "target_space", "user_id", "agent_id")
    sources = memories.drop("agent_id").join(new, "id")
    made = shared_copy(sources, as_of, visibility)
    events = share_events(sources.select(
        copy_id(F.col("id"), F.col("target_space")).alias("memory_id"), F.col("space_id").alias("from_space"),
        F.col("target_space").alias("to_space"), "user_id", "agent_id", "content"), action, as_of)
    return Shared(made, results, events)


def share_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("target_space").agg(
        F.count_if(F.col("status") == "shared").alias("shared"), F.count_if(F.col("status") == "existing").alias("skipped"),
        F.count_if(F.col("status") == "not_found").alias("failed"))


def share_filter(memories: DataFrame, categories=(), tags=(), min_importance: float | None = None) -> DataFrame:
    rows = memories
    if categories:
        rows = rows.filter(F.col("category").isin(*categories))
    if tags:
        rows = rows.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return rows if min_importance is None else rows.filter(F.col("importance") >= min_importance)


def pull(requests: DataFrame, memories: DataFrame, as_of, visibility: str = "private") -> Shared:
    """Copies into the personal space of the asking user. ``requests``: memory_id, user_id, agent_id."""
    personal = requests.withColumn("target_space", F.concat(F.lit("personal/"), "user_id"))
    return share(personal, memories, as_of, "pull", visibility)


def unshare(requests: DataFrame, memories: DataFrame, spaces: DataFrame, members: DataFrame) -> DataFrame:
    """(memory_id, target_space, user_id, copy_id, status): the first copy goes if the user shared it, owns or administers the space."""
    copies = top_n(
        memories.filter(F.col("shared_from_memory").isNotNull()).select(
            F.col("shared_from_memory").alias("memory_id"), F.col("space_id").alias("target_space"),
            F.col("id").alias("copy_id"), "shared_by_user"),
        ["memory_id", "target_space"], [F.col("copy_id")], 1)
    chiefs = graph.accessible_spaces(spaces, members).filter(F.col("role").isin("owner", "admin")).select(
        "user_id", F.col("space_id").alias("target_space"), F.lit(True).alias("_chief"))
    joined = requests.select("memory_id", "target_space", "user_id").distinct().join(
        copies, ["memory_id", "target_space"], "left").join(chiefs, ["user_id", "target_space"], "left")
    may = (F.col("shared_by_user") == F.col("user_id")) | F.col("_chief")
    status = (F.when(F.col("copy_id").isNull(), F.lit("not_found"))
              .when(F.coalesce(may, F.lit(False)), F.lit("removed")).otherwise(F.lit("refused")))
    return joined.select("memory_id", "target_space", "user_id", "copy_id", status.alias("status"))


def reshare(memories: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(fresh copies, ids they replace): stale copies whose source still exists are made anew from it."""
    stale = graph.stale_copies(memories).filter("is_stale AND NOT source_deleted").select(F.col("id").alias("old_id"))
    old = memories.join(stale, F.col("id") == F.col("old_id"), "left_semi").select(
        F.col("id").alias("old_id"), F.col("shared_from_memory").alias("_source"), F.col("space_id").alias("target_space"),
        F.col("shared_by_user").alias("user_id"), F.col("shared_by_agent").alias("agent_id"))
    sources = memories.drop("agent_id").join(old, F.col("id") == F.col("_source"))
    return shared_copy(sources.drop("_source", "old_id"), as_of), old.select(F.col("old_id").alias("id"))


def auto_share(memories: DataFrame, spaces: DataFrame, members: DataFrame, rules: DataFrame, as_of,
               skip_existing: DataFrame | None = None) -> DataFrame:
    """(memory_id, target_space, user_id, rule_id): per memory and space the first rule that applies.

    ``rules``: rule_id, space_id, source_space, categories, tags, min_importance, require_approval. Empty lists match
    all. Copies that exist (``skip_existing``: the memory table) are left out, so the operator can be repeated.
    """
    reach = graph.accessible_spaces(spaces, members).select("user_id", F.col("space_id").alias("target_space"))
    open_rules = rules.filter("NOT require_approval").select(
        "rule_id", F.col("space_id").alias("target_space"), F.col("source_space").alias("space_id"), "categories",
        F.col("tags").alias("_tags"), "min_importance")
    rows = memories.select(F.col("id").alias("memory_id"), "space_id", "category", "tags", "importance", F.col("tenant_id").alias("user_id"))
    fits = (
        ((F.size("categories") == 0) | F.array_contains("categories", F.col("category")))
        & ((F.size("_tags") == 0) | F.arrays_overlap("_tags", "tags"))
        & (F.col("importance") >= F.col("min_importance"))
    )
    hits = rows.join(open_rules, "space_id").filter(fits).join(reach, ["user_id", "target_space"], "left_semi")
    first = hits.groupBy("memory_id", "target_space", "user_id").agg(F.min("rule_id").alias("rule_id"))
    if skip_existing is None:
        return first
    copies = skip_existing.filter(F.col("shared_from_memory").isNotNull()).select(
        F.col("shared_from_memory").alias("memory_id"), F.col("space_id").alias("target_space")).distinct()
    return first.join(copies, ["memory_id", "target_space"], "left_anti")


def share_to_users(pairs: DataFrame, memories: DataFrame, spaces: DataFrame, members: DataFrame, as_of) -> tuple[Shared, DataFrame]:
    """Shares the memories of ``user_a`` with ``user_b`` over their bridge space. ``pairs``: user_a, user_b, memory_id."""
    bridges = graph.bridge_space(pairs, spaces, members)
    asked = pairs.join(bridges, ["user_a", "user_b"]).select(
        "memory_id", F.col("space_id").alias("target_space"), F.col("user_a").alias("user_id"), F.lit("").alias("agent_id"))
    return share(asked, memories, as_of), bridges
