"""Statistics over memories, sharing and recall. One pass per input where the counts allow it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from .ranking import top_n

DIMENSIONS = {
    "type": "memory_type", "category": "category", "tier": "tier", "state": "state",
    "space": "space_key", "visibility": "visibility", "agent": "owner_agent_id", "source": "source_key",
}
SHARES = ("share", "batch_share", "reshare")


def space_key():
    return F.when(F.col("space_id") == "", F.lit("default")).otherwise(F.col("space_id"))


def memory_stats(memories: DataFrame) -> DataFrame:
    """Long form (dimension, key, value): counts by eight dimensions plus total, averages and access sum.

    Grouping sets would send every row once per dimension into the partial aggregate as wide rows; exploding
    (dimension, key) pairs does the same with two narrow columns, and map-side combine leaves few rows to shuffle.
    """
    rows = memories.withColumn("space_key", space_key()).withColumn(
        "source_key", F.coalesce("source", F.lit("store")))
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("key")) for d, c in DIMENSIONS.items()])
    counts = rows.select(F.inline(pairs)).groupBy("dimension", "key").agg(F.count("*").cast("double").alias("value"))
    totals = memories.agg(
        F.count("*").cast("double").alias("total"),
        F.avg("importance").alias("avg_importance"),
        F.avg("confidence").alias("avg_confidence"),
        F.sum("access_count").cast("double").alias("total_access"),
    ).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("dimension"), F.lit("").alias("key"), F.coalesce(F.col(n), F.lit(0.0)).alias("value"))
        for n in ("total", "avg_importance", "avg_confidence", "total_access")])))
    return counts.unionByName(totals)


def timeline(memories: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Created rows per day and type since ``as_of - days``."""
    first = F.date_sub(F.to_date(times.moment(as_of)), days)
    day = F.to_date("created_at")
    return memories.filter(day >= first).groupBy(day.alias("day"), "memory_type").agg(F.count("*").alias("n"))


def tag_usage(memories: DataFrame) -> DataFrame:
    """(tag, usages, spaces). Two levels of grouping, so a hot tag is combined per space first."""
    per_space = memories.select(F.explode("tags").alias("tag"), space_key().alias("space")).groupBy("tag", "space").agg(
        F.count("*").alias("n"))
    return per_space.groupBy("tag").agg(F.sum("n").alias("usages"), F.count("*").alias("spaces"))


def tag_stats(memories: DataFrame, limit: int | None = 100, min_count: int = 1) -> DataFrame:
    """The most used tags; with None all."""
    used = tag_usage(memories).filter(F.col("usages") >= min_count)
    return used if limit is None else used.orderBy(F.desc("usages"), "tag").limit(limit)


def cross_space_tags(memories: DataFrame) -> DataFrame:
    """Tags used in two spaces or more; the minimum count does not apply."""
    return tag_usage(memories).filter(F.col("spaces") >= 2)


def tag_totals(memories: DataFrame, min_count: int = 1) -> DataFrame:
    return tag_usage(memories).agg(
        F.count_if(F.col("usages") >= min_count).alias("unique_tags"), F.sum("usages").alias("usages"))


def top_categories(memories: DataFrame, by: str, n: int = 3) -> DataFrame:
    """Most frequent categories per group, as text ``name:count|...``."""
    counts = memories.groupBy(by, "category").agg(F.count("*").alias("n"))
    best = top_n(counts, [by], [F.desc("n"), F.col("category")], n)
    entry = F.struct((-F.col("n")).alias("o"), F.col("category").alias("c"))
    return best.groupBy(by).agg(F.sort_array(F.collect_list(entry)).alias("_e")).select(
        by, F.array_join(F.transform("_e", lambda e: F.concat(e["c"], F.lit(":"), (-e["o"]).cast("string"))), "|")
        .alias("top_categories"))


def space_stats(spaces: DataFrame, memories: DataFrame, members: DataFrame) -> DataFrame:
    """Per space: rows, agents, tier counts, top categories, last activity, copies in, members."""
    per_agent = memories.groupBy("space_id", "owner_agent_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("tier") == "core").alias("core"),
        F.count_if(F.col("tier") == "working").alias("working"),
        F.count_if(F.col("tier") == "peripheral").alias("peripheral"),
        F.max("created_at").alias("last_activity"),
        F.count("shared_from_memory").alias("shared_in"),
    )
    facts = per_agent.groupBy("space_id").agg(
        F.sum("n").alias("memories"), F.count("*").alias("agents"), F.sum("core").alias("core"),
        F.sum("working").alias("working"), F.sum("peripheral").alias("peripheral"),
        F.max("last_activity").alias("last_activity"), F.sum("shared_in").alias("shared_in"))
    joined = (
        spaces.join(facts, "space_id", "left")
        .join(top_categories(memories, "space_id"), "space_id", "left")
        .join(members.groupBy("space_id").agg(F.count("*").alias("members")), "space_id", "left")
    )
    counts = ["memories", "agents", "core", "working", "peripheral", "shared_in", "members"]
    return joined.fillna(0, counts).fillna("", ["top_categories"])


def _recent(events: DataFrame, as_of, days: int) -> DataFrame:
    return events.filter(F.col("ts") >= times.moment(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))


def sharing_summary(events: DataFrame, as_of, days: int = 30) -> DataFrame:
    shares = F.col("action").isin(*SHARES)
    per_user = _recent(events, as_of, days).groupBy("user_id").agg(
        F.count_if(shares).alias("shares"),
        F.count_if(F.col("action") == "pull").alias("pulls"),
        F.count_if(F.col("action") == "unshare").alias("unshares"))
    return per_user.agg(
        F.coalesce(F.sum("shares"), F.lit(0)).alias("total_shares"),
        F.coalesce(F.sum("pulls"), F.lit(0)).alias("total_pulls"),
        F.coalesce(F.sum("unshares"), F.lit(0)).alias("total_unshares"),
        F.count_if(F.col("shares") > 0).alias("unique_sharers"))


def sharing_edges(events: DataFrame, as_of, days: int = 30) -> DataFrame:
    return _recent(events, as_of, days).filter(F.col("action").isin(*SHARES)).groupBy("from_space", "to_space").agg(
        F.count("*").alias("n"))


def sharing_days(events: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Per day: shares (without reshares) and pulls."""
    return _recent(events, as_of, days).groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("action").isin("share", "batch_share")).alias("shares"),
        F.count_if(F.col("action") == "pull").alias("pulls"))


def agent_spaces(memories: DataFrame) -> DataFrame:
    """Rows per owner agent and space."""
    return memories.groupBy("owner_agent_id", space_key().alias("space")).agg(F.count("*").alias("n"))


def agent_stats(memories: DataFrame, events: DataFrame) -> DataFrame:
    """Per owner agent: rows, top categories, last active, shares made."""
    facts = memories.groupBy("owner_agent_id").agg(F.count("*").alias("memories"), F.max("created_at").alias("last_active"))
    shares = events.filter(F.col("action").isin("share", "batch_share")).groupBy(
        F.col("agent_id").alias("owner_agent_id")).agg(F.count("*").alias("shares"))
    return (
        facts.join(top_categories(memories, "owner_agent_id"), "owner_agent_id")
        .join(shares, "owner_agent_id", "left").fillna(0, ["shares"])
    )


def session_groups(events: DataFrame) -> DataFrame:
    """Per session: recalls by kind, last time and latest query."""
    return events.groupBy("session_id").agg(
        F.count("*").alias("recalls"),
        F.count_if(F.col("recall_type") == "auto").alias("auto"),
        F.count_if(F.col("recall_type") == "manual").alias("manual"),
        F.max("ts").alias("last_ts"),
        F.max_by("query_text", F.struct("ts", "event_id")).alias("latest_query"))


def profile_stats(preferences: DataFrame) -> DataFrame:
    """Per tenant, long form: counts by scope and by status."""
    pairs = F.array(
        F.struct(F.lit("scope").alias("dimension"), F.col("scope").alias("key")),
        F.struct(F.lit("status").alias("dimension"), F.col("status").alias("key")))
    return preferences.select("tenant_id", F.inline(pairs)).groupBy("tenant_id", "dimension", "key").agg(
        F.count("*").alias("n"))


def last_runs(runs: DataFrame) -> DataFrame:
    """Latest induction run per tenant. ``runs``: run_id, tenant_id, status, started_at."""
    latest = F.struct("started_at", "run_id")
    return runs.groupBy("tenant_id").agg(
        F.max("started_at").alias("last_run"), F.max_by("status", latest).alias("last_status"))


def recall_verdict(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Per query: mean and best score, and whether the best passes the gate. ``queries``: query_id, gate."""
    scores = results.groupBy("query_id").agg(
        F.count("*").alias("n"), F.avg("score").alias("confidence"), F.max("score").alias("max_score"))
    joined = queries.join(scores, "query_id", "left").fillna(0, ["n"]).fillna(0.0, ["confidence", "max_score"])
    best = F.greatest("max_score", F.lit(0.0))
    return joined.withColumn("max_score", best).withColumn(
        "reason",
        F.when(F.col("n") == 0, F.lit("no_relevant_memories"))
        .when(F.col("max_score") <= F.col("gate"), F.lit("below_quality_gate"))
        .otherwise(F.lit("ok")),
    ).withColumn("should_recall", F.col("reason") == "ok")


def retrieval_trace(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Per query and stage: rows in, rows out, dropped, lowest and highest score.

    ``stages``: candidates (query_id, memory_id, score) after each stage, in order.
    """
    rows = None
    for place, (name, df) in enumerate(stages):
        part = df.select("query_id", F.lit(place).alias("stage_no"), F.lit(name).alias("stage"), "score")
        rows = part if rows is None else rows.unionByName(part)
    counted = rows.groupBy("query_id", "stage_no", "stage").agg(
        F.count("*").alias("rows_out"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))
    before = Window.partitionBy("query_id").orderBy("stage_no")
    return counted.withColumn("rows_in", F.lag("rows_out", 1, 0).over(before)).withColumn(
        "dropped", F.greatest(F.col("rows_in") - F.col("rows_out"), F.lit(0)))


def demote_kept(entries: DataFrame, archive: DataFrame) -> DataFrame:
    """An added entry whose name is in the archive becomes kept, its texts cleared. ``archive``: name."""
    known = archive.select("name").distinct().withColumn("_known", F.lit(True))
    joined = entries.join(known, "name", "left")
    collides = (F.col("source") == "added") & F.col("_known").isNotNull()
    for column in ("description", "body"):
        joined = joined.withColumn(column, F.when(collides, F.lit("")).otherwise(F.col(column)))
    return joined.withColumn("source", F.when(collides, F.lit("kept")).otherwise(F.col("source"))).drop("_known")


def consolidation_stats(entries: DataFrame, archive: DataFrame, by: str) -> DataFrame:
    """Counts by source per group, after the collision rule."""
    source = F.col("source")
    return demote_kept(entries, archive).groupBy(by).agg(
        F.count_if(source == "merged").alias("merged"), F.count_if(source == "updated").alias("updated"),
        F.count_if(source == "added").alias("added"), F.count_if(source == "kept").alias("kept"),
        F.count("*").alias("total"))


def archive_names(archives: DataFrame) -> DataFrame:
    """Entry names in archive texts: lines ``name: ...`` without quotes. ``archives``: id, text."""
    from ..functions.columns import lines, strip

    line = strip(F.col("line"))
    name = F.regexp_replace(strip(F.substr(line, F.lit(6))), '^"+|"+$', "")
    return archives.select("id", F.explode(lines(F.col("text"))).alias("line")).filter(
        F.startswith(line, F.lit("name:"))).select("id", name.alias("name")).filter(F.col("name") != "")


def retrieval_eval(results: DataFrame, texts: DataFrame, expectations: DataFrame, k: int = 5) -> DataFrame:
    """Per expectation: passed when the best ``k`` texts hold the wanted string and not the forbidden one.

    ``results``: query_id, memory_id, score, text_id. ``texts``: text_id, content; results without a text do not count. Only the
    best results meet their texts. ``expectations``: query_id, should_contain, should_not_contain.
    """
    known = results.join(texts.select("text_id"), "text_id", "left_semi")
    best = top_n(known, ["query_id"], [F.desc("score"), F.col("memory_id")], k).join(texts, "text_id")
    texts = best.groupBy("query_id").agg(
        F.lower(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "memory_id", "content"))),
            lambda r: r["content"]), " ")).alias("_text"), F.count("*").alias("results"))
    joined = expectations.join(texts, "query_id", "left").fillna(0, ["results"])
    wanted = F.lower(F.coalesce("should_contain", F.lit("")))
    banned = F.lower(F.coalesce("should_not_contain", F.lit("")))
    found = (wanted == "") | F.contains(F.coalesce("_text", F.lit("")), wanted)
    clean = (banned == "") | ~F.contains(F.coalesce("_text", F.lit("")), banned)
    return joined.withColumn("passed", (F.col("results") > 0) & found & clean).drop("_text")


def eval_score(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"),
        F.coalesce(F.avg(F.col("passed").cast("double")) * 100, F.lit(0.0)).alias("score"))


def chain_inherit(chains: DataFrame, memories: DataFrame) -> DataFrame:
    """Highest tier, top importance and united tags of a chain. ``chains``: root_id, id."""
    from .lifecycle import tier_rank

    rows = chains.join(memories.select("id", "tier", "importance", "tags"), "id")
    facts = rows.groupBy("root_id").agg(
        F.max_by("tier", tier_rank(F.col("tier"))).alias("tier"), F.max("importance").alias("importance"))
    tags = rows.select("root_id", F.explode("tags").alias("tag")).distinct().groupBy("root_id").agg(
        F.array_join(F.array_sort(F.collect_list("tag")), "|").alias("tags"))
    return facts.join(tags, "root_id", "left").fillna("", ["tags"])


def spaces_union(memories: DataFrame, accessible: DataFrame) -> DataFrame:
    """Memories over each user's spaces, once per id; the personal space wins. ``accessible``: user_id, space_id, space_type."""
    rows = memories.join(accessible.select("user_id", "space_id", "space_type"), "space_id")
    first = F.when(F.col("space_type") == "personal", 0).otherwise(1)
    return top_n(rows, ["user_id", "id"], [first, F.col("space_id")], 1)
