"""Row predicates, lookups and projections over the memory table. All of them push down to the scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times


@dataclass(frozen=True)
class ListFilter:
    category: str | None = None
    tier: str | None = None
    tags: tuple[str, ...] = ()
    memory_type: str | None = None
    state: str | None = None
    visibility: str | None = None
    project_path: str | None = None
    global_scope: str | None = None  # "only" or "exclude"


def all_of(conditions) -> Column:
    result = F.lit(True)
    for condition in conditions:
        result = result & condition
    return result


def list_condition(wanted: ListFilter) -> Column:
    equal = [
        F.col(name) == getattr(wanted, name)
        for name in ("state", "category", "tier", "memory_type", "visibility")
        if getattr(wanted, name) is not None
    ]
    parts = [*equal, *[F.array_contains("tags", tag) for tag in wanted.tags]]
    if wanted.project_path is not None:
        parts.append(related_path(F.col("project_path"), F.lit(wanted.project_path)))
    if wanted.global_scope is not None:
        parts.append(in_global_scope(wanted.global_scope))
    return all_of(parts)


def filter_memories(memories: DataFrame, wanted: ListFilter) -> DataFrame:
    return memories.filter(list_condition(wanted))


def related_path(stored: Column, path: Column) -> Column:
    """Equal, child or parent of ``path``; prefixes are literal."""
    return (
        (stored == path)
        | F.startswith(stored, F.concat(path, F.lit("/")))
        | F.startswith(path, F.concat(stored, F.lit("/")))
    )


def path_applies(stored: Column, visibility: Column, path: Column) -> Column:
    """Search form of the project filter: no path and private rows always pass."""
    return stored.isNull() | related_path(stored, path) | (visibility == "private")


def project_scope(memories: DataFrame, path: str) -> DataFrame:
    return memories.filter(path_applies(F.col("project_path"), F.col("visibility"), F.lit(path)))


def in_global_scope(mode: str) -> Column:
    if mode == "only":
        return F.col("project_path").isNull()
    if mode == "exclude":
        return F.col("project_path").isNotNull() & (F.col("project_path") != "")
    raise ValueError(f"unknown scope {mode!r}")


def visible(agent: str, spaces) -> Column:
    shared = [f"shared:{space}" for space in spaces]
    own = (F.col("visibility") == "private") & (F.col("owner_agent_id") == agent) if agent else F.lit(False)
    return (F.col("visibility") == "global") | own | F.col("visibility").isin(shared)


def visible_to(memories: DataFrame, agent: str, spaces) -> DataFrame:
    return memories.filter(visible(agent, spaces))


def access_key() -> Column:
    """The one key that opens a memory: ``global``, ``private:<owner>`` or ``shared:<space>``."""
    return F.when(
        F.col("visibility") == "private", F.concat(F.lit("private:"), "owner_agent_id")
    ).otherwise(F.col("visibility"))


def store_key() -> Column:
    """``access_key`` within the store of a tenant; shared rows belong to their space, whoever wrote them."""
    return F.when(F.startswith(F.col("visibility"), F.lit("shared:")), F.col("visibility")).otherwise(
        F.concat("tenant_id", F.lit("/"), access_key()))


def store_name() -> Column:
    """The store that a memory's counts belong to: its space where it is shared, else its tenant."""
    return F.when(F.startswith(F.col("visibility"), F.lit("shared:")), F.col("visibility")).otherwise(F.col("tenant_id"))


def agent_keys(agents: DataFrame) -> DataFrame:
    """(agent_id, access_key) without the global key. ``agents``: agent_id, spaces array."""
    own = F.when(F.col("agent_id") != "", F.concat(F.lit("private:"), "agent_id"))
    shared = F.transform("spaces", lambda s: F.concat(F.lit("shared:"), s))
    return agents.select("agent_id", F.explode(F.array_compact(F.concat(F.array(own), shared))).alias("access_key"))


def visible_to_each(memories: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent_id, memory) for every agent: an equi join on the access key.

    Global rows go to every agent, so they get one copy of every agent's key instead of a condition join.
    """
    everyone = agents.select("agent_id", F.lit("global").alias("access_key"))
    keys = agent_keys(agents).unionByName(everyone).distinct()
    return memories.withColumn("access_key", access_key()).join(keys, "access_key").drop("access_key")


def has_all_tags(memories: DataFrame, tags) -> DataFrame:
    return memories.filter(all_of(F.array_contains("tags", tag) for tag in tags))


@dataclass(frozen=True)
class DeleteFilter:
    source_prefix: str | None = None
    tags: tuple[str, ...] = ()
    category: str | None = None
    memory_type: str | None = None
    state: str | None = None
    before: object = None


def delete_condition(wanted: DeleteFilter) -> Column:
    parts = [F.array_contains("tags", tag) for tag in wanted.tags]
    parts += [
        F.col(name) == getattr(wanted, name)
        for name in ("category", "memory_type", "state")
        if getattr(wanted, name) is not None
    ]
    if wanted.source_prefix is not None:
        parts.append(F.startswith("source", F.lit(wanted.source_prefix)))
    if wanted.before is not None:
        parts.append(F.col("created_at") < times.moment(wanted.before))
    return F.coalesce(all_of(parts), F.lit(False))


def delete_preview(memories: DataFrame, wanted: DeleteFilter) -> DataFrame:
    return memories.filter(delete_condition(wanted)).agg(F.count("*").alias("would_delete"))


def delete_where(memories: DataFrame, wanted: DeleteFilter) -> DataFrame:
    return memories.filter(~delete_condition(wanted))


def batch_get(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id").distinct(), "id", "left_semi")


def digest(memories: DataFrame, limit: int | None = 100) -> DataFrame:
    """Newest first: id, title, category, tags, preview, update time."""
    rows = memories.select(
        "id", F.col("l0_abstract").alias("title"), "category", "tags",
        F.substring("content", 1, 200).alias("preview"), "updated_at",
    ).orderBy(F.desc("updated_at"), "id")
    return rows if limit is None else rows.limit(limit)


def mask_private(memories: DataFrame, vault_spaces: DataFrame, mask: str = "[PRIVATE]") -> DataFrame:
    """Texts of private memories are hidden where their space has a vault. ``vault_spaces``: space_id."""
    vaults = vault_spaces.select("space_id").distinct().withColumn("_vault", F.lit(True))
    joined = memories.join(vaults, "space_id", "left")
    hide = (F.col("scope") == "private") & F.col("_vault").isNotNull()
    for name in ("content", "l0_abstract", "l1_overview", "l2_content"):
        if name in memories.columns:
            joined = joined.withColumn(name, F.when(hide, F.lit(mask)).otherwise(F.col(name)))
    return joined.drop("_vault")


def path_problem(path: Column) -> Column:
    """Why a project path is refused, else null. The limit counts bytes."""
    return (
        F.when(F.octet_length(path) > 512, F.lit("too_long"))
        .when(path.contains(".."), F.lit("path_traversal"))
        .when(path.contains("'") | path.contains(";") | path.contains("--"), F.lit("invalid_characters"))
    )


def normalize_project_paths(memories: DataFrame, home_paths: DataFrame) -> DataFrame:
    """Empty and home paths become null, refused ones are flagged. ``home_paths``: path."""
    homes = home_paths.select(F.rtrim("path", F.lit("/")).alias("_home")).distinct().withColumn("_hit", F.lit(True))
    joined = memories.withColumn("path_problem", path_problem(F.col("project_path"))).join(
        homes, F.rtrim("project_path", F.lit("/")) == F.col("_home"), "left"
    )
    clear = (F.col("project_path") == "") | F.col("_hit").isNotNull()
    return joined.withColumn("project_path", F.when(~clear, F.col("project_path"))).drop("_home", "_hit")


def count_where(memories: DataFrame, wanted: ListFilter) -> DataFrame:
    return filter_memories(memories, wanted).agg(F.count("*").alias("n"))


def count_by_session(memories: DataFrame) -> DataFrame:
    return memories.groupBy("session_id").agg(F.count("*").alias("n"))


def project_paths(memories: DataFrame, limit: int | None = 50) -> DataFrame:
    """The first paths in order; with None all."""
    paths = memories.select("project_path").filter(F.col("project_path") != "").distinct()
    return paths if limit is None else paths.orderBy("project_path").limit(limit)


def reembed_worklist(memories: DataFrame) -> DataFrame:
    """(id, text to embed): the abstract, or the content where it is empty."""
    text = F.when(F.coalesce(F.col("l0_abstract"), F.lit("")) != "", F.col("l0_abstract")).otherwise(F.col("content"))
    return memories.select("id", text.alias("embed_text"))
