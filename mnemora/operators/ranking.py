"""Ranks, budgets, pages and top-k. Windows are per query, session or space; ties break by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lines

SORTS = ("importance", "access_count", "updated_at", "created_at")


def top_n(df: DataFrame, by, order, n: int | None) -> DataFrame:
    """First ``n`` rows of each group, all with None. Spark cuts each partition before the shuffle (WindowGroupLimit)."""
    if n is None:
        return df
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def list_page(memories: DataFrame, sort: str = "created_at", descending: bool = True,
              limit: int = 20, offset: int = 0) -> DataFrame:
    """A page in a stable order. An unknown sort falls back to the creation time."""
    column = F.col(sort if sort in SORTS else "created_at")
    return memories.orderBy(column.desc() if descending else column.asc(), "id").offset(offset).limit(limit)


def page_total(memories: DataFrame) -> DataFrame:
    return memories.agg(F.count("*").alias("total_count"))


def topk_cap(candidates: DataFrame, n: int, score: str = "score") -> DataFrame:
    return top_n(candidates, ["query_id"], [F.desc(score), F.col("memory_id")], n)


def rank_leg(hits: DataFrame) -> DataFrame:
    """1-based rank per query and leg."""
    window = Window.partitionBy("query_id", "leg").orderBy(F.desc("score"), "memory_id")
    return hits.withColumn("rank", F.row_number().over(window))


def minmax(candidates: DataFrame, score: str = "score") -> DataFrame:
    """Min-max per query: all equal gives 1, a single row min(1, 120 x score)."""
    window = Window.partitionBy("query_id")
    low, high, n = F.min(score).over(window), F.max(score).over(window), F.count("*").over(window)
    scaled = (
        F.when(n == 1, F.least(F.col(score) * 120.0, F.lit(1.0)))
        .when(high > low, (F.col(score) - low) / (high - low))
        .when(high > 0, F.lit(1.0))
        .otherwise(F.col(score))
    )
    return candidates.withColumn(score, scaled)


def recent_recalls(events: DataFrame, n: int) -> DataFrame:
    return top_n(events, ["tenant_id", "session_id"], [F.desc("ts"), F.col("event_id")], n)


def _until_overflow(df: DataFrame, by, order, size: Column, smallest: int, budget: int) -> DataFrame:
    """Rows in order while the running size fits; everything from the first overflow on is dropped.

    Sizes are at least ``smallest``, so no row behind place budget / smallest can fit: those are cut before the
    shuffle, and a group of any size leaves few rows for the running sum.
    """
    df = top_n(df, by, order, budget // smallest + 1)
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_used", F.sum(size).over(window)).filter(F.col("_used") <= budget).drop("_used")


def select_recent(messages: DataFrame, count: int | None = 20, budget: int | None = 200_000) -> DataFrame:
    """Newest messages of each conversation within a count and a byte budget (None: no bound); the newest always stays."""
    newest = top_n(messages, ["conv_id"], [F.desc("turn")], count)
    if budget is None:
        return newest
    window = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    used, place = F.sum(F.octet_length("content")).over(window), F.count("*").over(window)
    return newest.withColumn("_fits", (used <= budget) | (place == 1)).filter("_fits").drop("_fits")


def pack_budget(preferences: DataFrame, by, budget: int = 3000) -> DataFrame:
    """Preference lines by falling confidence while their bytes fit."""
    size = F.octet_length(F.concat(F.lit("· "), "slot", F.lit(" — "), "value")) + 1
    # the marks around slot and value alone take 9 bytes
    return _until_overflow(preferences, by, [F.desc("confidence"), F.col("id")], size, 9, budget)


def two_phase_recall(project: DataFrame, everywhere: DataFrame, queries: DataFrame) -> DataFrame:
    """Project hits first, global hits fill up. ``queries``: query_id, max_results, has_project_tags.

    Both inputs: query_id, memory_id, score, rank. A query with project tags takes what is missing from the global
    hits; one without takes max_results of them.
    """
    tagged = queries.filter("has_project_tags").select("query_id", "max_results")
    first = project.join(tagged.select("query_id"), "query_id", "left_semi").withColumn("phase", F.lit(1))
    both = first.unionByName(everywhere.withColumn("phase", F.lit(2)))
    once = top_n(both, ["query_id", "memory_id"], [F.col("phase"), F.col("rank")], 1)
    per_phase = Window.partitionBy("query_id", "phase").orderBy("rank", "memory_id")
    per_query = Window.partitionBy("query_id")
    ranked = (
        once.withColumn("_n", F.row_number().over(per_phase))
        .withColumn("_first", F.count_if(F.col("phase") == 1).over(per_query))
        .join(queries.select("query_id", "max_results"), "query_id")
    )
    room = F.greatest(F.col("max_results") - F.col("_first"), F.lit(0))
    kept = ranked.filter((F.col("phase") == 1) | (F.col("_n") <= room))
    final = Window.partitionBy("query_id").orderBy("phase", "_n")
    return kept.withColumn("position", F.row_number().over(final)).select(
        "query_id", "memory_id", "score", "phase", "position")


def bare_topic(heading: Column) -> Column:
    """Heading text without ``## `` and a leading time stamp."""
    return F.regexp_replace(heading, r"^## ([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2} (?=.))?", "")


def summary_line() -> Column:
    topics = F.transform(F.filter(lines(F.col("content")), lambda l: F.startswith(l, F.lit("## "))), bare_topic)
    stamp = F.concat(F.lit("["), F.col("updated_at").cast("string"), F.lit("] "))
    plain = F.concat(stamp, "l0_abstract", F.lit(": "), "l1_overview")
    return F.when(F.size(topics) == 0, plain).otherwise(F.concat(stamp, F.array_join(topics, " | ")))


def merged_summary(memories: DataFrame, by, budget: int = 2000) -> DataFrame:
    """One summary text per group: lines, newest first, while bytes + 2 fit."""
    rows = memories.withColumn("_line", summary_line())
    order = [F.desc("updated_at"), F.col("id")]
    kept = _until_overflow(rows, by, order, F.octet_length("_line") + 2, 2, budget)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return (
        kept.withColumn("_place", place).groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct("_place", "_line"))).alias("_lines"))
        .select(*by, F.array_join(F.transform("_lines", lambda r: r["_line"]), "\n\n").alias("summary"))
    )


def recent_session_memories(memories: DataFrame, kind: str, n: int = 5) -> DataFrame:
    """Newest ``n`` private or work memories per session, with the total of the session."""
    if kind == "private":
        rows = memories.filter(F.col("scope") == "private")
    else:
        rows = memories.filter(
            (F.col("scope") != "private") & (F.col("category") != "preferences")
            & (F.col("source") == "session_ingest")
        )
    total = rows.groupBy("session_id").agg(F.count("*").alias("total"))
    return top_n(rows, ["session_id"], [F.desc("updated_at"), F.col("id")], n).join(total, "session_id")
