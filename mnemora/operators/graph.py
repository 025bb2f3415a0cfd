"""Joins over spaces, copies, relations and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import top_n

WRITERS = ("owner", "admin", "member")


def accessible_spaces(spaces: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, space_id, space_type, role, weight, access) for spaces owned or joined; ownership wins."""
    owned = spaces.select(F.col("owner_id").alias("user_id"), "space_id", F.lit("owner").alias("role"))
    joined = members.select("user_id", "space_id", "role")
    order = (F.when(F.col("role") == "owner", 0).when(F.col("role") == "admin", 1)
             .when(F.col("role") == "member", 2).otherwise(3))
    best = top_n(owned.unionByName(joined), ["user_id", "space_id"], [order, F.col("role")], 1)
    kinds = spaces.select("space_id", "space_type")
    weight = (F.when(F.col("space_type") == "personal", 1.0).when(F.col("space_type") == "team", 0.8).otherwise(0.6))
    access = F.when(F.col("role").isin(*WRITERS), F.lit("rw")).otherwise(F.lit("ro"))
    return best.join(kinds, "space_id").withColumn("weight", weight).withColumn("access", access)


def write_access(requests: DataFrame, spaces: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``can_write`` to (user_id, space_id) rows: owner, admin and member may, readers and outsiders not."""
    allowed = accessible_spaces(spaces, members).filter("access = 'rw'").select(
        "user_id", "space_id", F.lit(True).alias("can_write"))
    return requests.join(allowed, ["user_id", "space_id"], "left").fillna(False, ["can_write"])


def find_copies(memories: DataFrame, source_ids: DataFrame) -> DataFrame:
    wanted = source_ids.select(F.col("id").alias("shared_from_memory")).distinct()
    return memories.join(wanted, "shared_from_memory", "left_semi")


def stale_copies(memories: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Per row: is the copy older than its source? Null for rows that are no copy; a missing source is stale."""
    sources = memories if sources is None else sources
    now = sources.select(F.col("id").alias("_src"), F.coalesce("version", F.lit(0)).alias("source_now"))
    copy = F.col("shared_from_memory").isNotNull()
    missing = copy & F.col("source_now").isNull()
    return memories.join(now, F.col("shared_from_memory") == F.col("_src"), "left").select(
        "id", "shared_from_memory", "source_version", "source_now",
        F.when(copy, missing | (F.coalesce("source_version", F.lit(0)) < F.col("source_now"))).alias("is_stale"),
        F.when(copy, missing).alias("source_deleted"),
    )


def events_with_items(events: DataFrame, items: DataFrame) -> DataFrame:
    """Each event with its list of items; the list may be empty."""
    lists = items.groupBy("event_id").agg(
        F.sort_array(F.collect_list(F.struct("item_id", "memory_id", "score", "is_kept"))).alias("items"))
    empty = F.array().cast(lists.schema["items"].dataType)
    return events.join(lists, "event_id", "left").withColumn("items", F.coalesce("items", empty))


def cascade_delete(events: DataFrame, items: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of the sessions and their items are removed."""
    gone = events.join(sessions.select("session_id").distinct(), "session_id", "left_semi").select("event_id")
    return (
        events.join(sessions.select("session_id").distinct(), "session_id", "left_anti"),
        items.join(gone, "event_id", "left_anti"),
    )


def minus_existing(new: DataFrame, existing: DataFrame, on) -> DataFrame:
    return new.join(existing.select(*on).distinct(), list(on), "left_anti")


def dedup_messages(new: DataFrame, stored: DataFrame, within_batch: bool = False) -> DataFrame:
    """Drops messages whose hash is stored. Copies inside the batch stay unless ``within_batch``."""
    fresh = with_hash(new).join(stored.select("content_hash").distinct(), "content_hash", "left_anti")
    return fresh.dropDuplicates(["content_hash"]) if within_batch else fresh


def with_hash(messages: DataFrame) -> DataFrame:
    return messages.withColumn("content_hash", F.sha2(F.concat("session_id", "role", "content"), 256))


def bridge_space(pairs: DataFrame, spaces: DataFrame, members: DataFrame) -> DataFrame:
    """(user_a, user_b, space_id, is_new): the first team space both belong to, else a new one named after the pair.

    The pair list drives the join, so no self product of the members of a space is built.
    """
    teams = accessible_spaces(spaces, members).filter("space_type = 'team'").select("user_id", "space_id")
    asked = pairs.select("user_a", "user_b").distinct()
    of_a = asked.join(teams.withColumnRenamed("user_id", "user_a"), "user_a")
    both = of_a.join(teams.withColumnRenamed("user_id", "user_b"), ["user_b", "space_id"])
    found = both.groupBy("user_a", "user_b").agg(F.min("space_id").alias("_found"))
    fresh = F.concat(F.lit("team/"), F.substring(F.sha2(F.concat_ws("|", "user_a", "user_b"), 256), 1, 32))
    return asked.join(found, ["user_a", "user_b"], "left").select(
        "user_a", "user_b", F.coalesce("_found", fresh).alias("space_id"), F.col("_found").isNull().alias("is_new"))


def new_bridge_rows(bridges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(space rows, member rows) of the new bridges: the first user owns and administers."""
    new = bridges.filter("is_new")
    name = F.concat(F.lit("shared-"), F.substring("user_a", 1, 8), F.lit("-"), F.substring("user_b", 1, 8))
    spaces = new.select("space_id", F.lit("team").alias("space_type"), F.col("user_a").alias("owner_id"), name.alias("name"))
    members = new.select("space_id", F.inline(F.array(
        F.struct(F.col("user_a").alias("user_id"), F.lit("admin").alias("role")),
        F.struct(F.col("user_b").alias("user_id"), F.lit("member").alias("role")))))
    return spaces, members


def resolve_category(rows: DataFrame, categories: DataFrame | None, aliases: DataFrame | None) -> DataFrame:
    """Lower-cased name, else alias target, else as it is. Without a registry only the fallback names stay."""
    from ..schema import FALLBACK_CATEGORIES

    lowered = rows.withColumn("category", F.lower(F.trim("category")))
    if categories is None:
        return lowered.filter(F.col("category").isin(*FALLBACK_CATEGORIES))
    exact = categories.select("tenant_id", F.col("name").alias("category"), F.lit(True).alias("_exact"))
    alias = aliases.select("tenant_id", F.col("alias").alias("category"), "target")
    joined = lowered.join(exact, ["tenant_id", "category"], "left").join(alias, ["tenant_id", "category"], "left")
    return joined.withColumn(
        "category", F.when(F.col("_exact"), F.col("category")).otherwise(F.coalesce("target", "category"))
    ).drop("_exact", "target")


def category_weights(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds admission weight and importance base of the tenant's category, 0.5 where unknown."""
    known = categories.select("tenant_id", F.col("name").alias("category"), "admission_weight", "importance_base")
    return rows.join(known, ["tenant_id", "category"], "left").fillna(0.5, ["admission_weight", "importance_base"])


def expand_relations(candidates: DataFrame, relations: DataFrame, memories: DataFrame, cap: int | None = 20,
                     queries: DataFrame | None = None) -> DataFrame:
    """Related memories not among the candidates, lowest ids first, at 0.8 x the lowest score of the query.

    ``candidates``: query_id, memory_id, score. ``relations``: src_id, target_id. With ``queries`` (query_id, access_keys)
    and the column access_key in ``memories``, a query gets only what it may open. ``cap``: most rows added to a query.
    """
    targets = candidates.join(
        relations.select(F.col("src_id").alias("memory_id"), "target_id"), "memory_id"
    ).select("query_id", F.col("target_id").alias("memory_id")).distinct()
    fresh = targets.join(candidates.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
    if queries is None:
        stored = fresh.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    else:
        open_to = fresh.join(memories.select(F.col("id").alias("memory_id"), "access_key"), "memory_id").join(
            queries.select("query_id", "access_keys"), "query_id")
        stored = open_to.filter(F.array_contains("access_keys", F.col("access_key"))).select("query_id", "memory_id")
    chosen = top_n(stored, ["query_id"], [F.col("memory_id")], cap)
    lowest = candidates.groupBy("query_id").agg((F.min("score") * 0.8).alias("score"))
    return chosen.join(lowest, "query_id")


def relation_graph(memories: DataFrame, relations: DataFrame, min_importance: float = 0.0) -> DataFrame:
    """Edges (source, target, relation_type, cross_space) from relations, successors and provenance."""
    kept = memories.filter(F.col("importance") >= min_importance)
    spaces = kept.select("id", "space_id")
    declared = (
        relations.join(spaces.select(F.col("id").alias("src_id"), F.col("space_id").alias("_from")), "src_id")
        .join(spaces.select(F.col("id").alias("target_id"), F.col("space_id").alias("_to")), "target_id", "left")
        .select(F.col("src_id").alias("source"), F.col("target_id").alias("target"), "relation_type",
                F.coalesce((F.col("_from") != "") & (F.col("_to") != "") & (F.col("_from") != F.col("_to")),
                           F.lit(False)).alias("cross_space"))
    )
    replaced = kept.filter(F.col("superseded_by").isNotNull()).select(
        F.col("superseded_by").alias("source"), F.col("id").alias("target"),
        F.lit("supersedes").alias("relation_type"), F.lit(False).alias("cross_space"))
    shared = kept.filter(F.col("shared_from_memory").isNotNull()).select(
        F.col("shared_from_memory").alias("source"), F.col("id").alias("target"),
        F.lit("shared_from").alias("relation_type"),
        (F.col("shared_from_space") != F.col("space_id")).alias("cross_space"))
    return declared.unionByName(replaced).unionByName(shared)


def graph_nodes(memories: DataFrame, edges: DataFrame, min_importance: float = 0.0, limit: int | None = None) -> DataFrame:
    """Memories that touch an edge."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    nodes = memories.filter(F.col("importance") >= min_importance).join(ends, "id", "left_semi")
    return nodes if limit is None else nodes.orderBy("id").limit(limit)


def chain_tail(memories: DataFrame, relations: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(id, tail_id): end of the first ``continued_by`` link, followed to the last memory, of all memories or of ``starts`` (id).

    Jumps of 1, 2, 4, .. links are tables of the memories that have so many links before them, so each is smaller than the one
    before; ``starts`` alone are then walked, from the longest jumps to the shortest. A walk into a cycle ends on the memory that
    links back to where the cycle was entered.
    """
    ids = memories.select("id")
    first = relations.filter("relation_type = 'continued_by'").groupBy("src_id").agg(F.min("target_id").alias("next"))
    links = first.join(ids.withColumnRenamed("id", "next"), "next", "left_semi").filter("src_id <> next").select(
        F.col("src_id").alias("id"), "next")
    links = cut_lineage(links)
    begun = ids if starts is None else ids.join(starts.select("id").distinct(), "id", "left_semi")
    jumps, turning = _jumps(links)
    if turning is None:
        return _landed(begun, jumps).select("id", F.col("at").alias("tail_id"))
    on_cycle = cut_lineage(turning.select(F.col("next").alias("at")).distinct())
    straight = cut_lineage(links.join(on_cycle.withColumnRenamed("at", "id"), "id", "left_anti"))
    entries = _landed(begun, _jumps(straight)[0])
    back = links.join(on_cycle.withColumnRenamed("at", "id"), "id", "left_semi").select(
        F.col("id").alias("_before"), F.col("next").alias("at"))
    return entries.join(back, "at", "left").select("id", F.coalesce("_before", "at").alias("tail_id"))


def _jumps(links: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (id, next) of jumps of 1, 2, 4, .. links; and, where walks longer than there are links show that some turn in a
    cycle, where these are then."""
    bound, span, out = links.count(), 1, [links]
    while True:
        last = out[-1]
        far = cut_lineage(last.join(last.select(F.col("id").alias("next"), F.col("next").alias("_far")), "next").select(
            "id", F.col("_far").alias("next")))
        if far.limit(1).count() == 0:
            return out, None
        span *= 2
        if span > bound:
            return out, far
        out.append(far)


def _landed(ids: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(id, at): where the walk from each id ends."""
    at = ids.select("id", F.col("id").alias("at"))
    for table in reversed(jumps):
        step = table.select(F.col("id").alias("at"), F.col("next").alias("_to"))
        at = at.join(step, "at", "left").select("id", F.coalesce("_to", "at").alias("at"))
    return at


def chain_members(roots: DataFrame, relations: DataFrame, memories: DataFrame, depth: int = 5) -> DataFrame:
    """(root_id, id, depth): closure over continues / continued_by, each memory once at its lowest depth."""
    links = relations.filter("relation_type IN ('continues', 'continued_by')").select(
        F.col("src_id").alias("id"), F.col("target_id").alias("next")).distinct()
    links = links.join(memories.select(F.col("id").alias("next")), "next", "left_semi")
    seen = roots.select("root_id", F.col("root_id").alias("id"), F.lit(0).alias("depth"))
    front = seen
    for level in range(1, depth + 1):
        nxt = front.join(links, "id").select("root_id", F.col("next").alias("id")).distinct()
        front = nxt.join(seen.select("root_id", "id"), ["root_id", "id"], "left_anti").withColumn("depth", F.lit(level))
        front = cut_lineage(front)
        seen = seen.unionByName(front)
    return seen


def merge_groups(memories: DataFrame, groups: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged rows, consumed ids, refused groups). ``groups``: group_id, id. ``contents``: group_id, merged_content.

    A group needs 2 to 10 members that all exist and belong to one tenant. The most confident row survives, then the
    most important, then the last id.
    """
    found = groups.join(memories.select("id", "tenant_id"), "id", "left")
    shape = found.groupBy("group_id").agg(
        F.count("*").alias("n"), F.count("tenant_id").alias("hits"),
        F.min("tenant_id").alias("_low"), F.max("tenant_id").alias("_high"))
    reason = (
        F.when(~F.col("n").between(2, 10), F.lit("size"))
        .when(F.col("hits") < F.col("n"), F.lit("not_found"))
        .when(F.col("_low") != F.col("_high"), F.lit("tenant"))
    )
    judged = shape.join(contents, "group_id", "left").withColumn(
        "reason", F.coalesce(reason, F.when(F.col("merged_content").isNull(), F.lit("content_required"))))
    refused = judged.filter(F.col("reason").isNotNull()).select("group_id", "n", "reason")
    valid = judged.filter(F.col("reason").isNull()).select("group_id", "merged_content")
    rows = groups.join(valid.select("group_id"), "group_id", "left_semi").join(memories, "id")
    best = Window.partitionBy("group_id").orderBy(F.desc("confidence"), F.desc("importance"), F.desc("id"))
    placed = rows.withColumn("_place", F.row_number().over(best))
    tags = rows.select("group_id", F.explode("tags").alias("tag")).distinct().groupBy("group_id").agg(
        F.array_sort(F.collect_list("tag")).alias("tags"))
    text = F.col("merged_content")
    overview = F.when(F.char_length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("..."))).otherwise(text)
    merged = (
        placed.filter("_place = 1").drop("tags", "_place", "content", "l0_abstract", "l1_overview", "l2_content")
        .join(valid, "group_id").join(tags, "group_id", "left")
        .withColumn("content", text).withColumn("l2_content", text)
        .withColumn("l0_abstract", F.substring(text, 1, 100)).withColumn("l1_overview", overview)
        .drop("merged_content")
    )
    return merged, placed.filter("_place > 1").select("group_id", "id"), refused
