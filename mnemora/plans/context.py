"""Context text of a session: profile, newest global and project memories, and search hits not shown yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from ..functions.columns import strip
from ..operators.filters import in_global_scope, path_applies
from ..operators.ranking import top_n

TITLES = {1: "## Global Memories", 2: "## Recent Project Activity", 3: "## Relevant Memories"}


def context_blocks(requests: DataFrame, memories: DataFrame, profiles: DataFrame, hits: DataFrame, as_of,
                   n_global: int = 5, n_recent: int = 5, limit: int = 10_000, mark: str = "MEMORY") -> DataFrame:
    """(session_id, text). ``requests``: session_id, tenant_id, project (may be null). ``profiles``: tenant_id, project,
    content. ``hits``: session_id, memory_id, score. Longer texts are cut at a line end.

    Newest rows are chosen once per tenant, and per (tenant, project), before they meet the requests.
    """
    memories = memories.select("id", "tenant_id", "project_path", "visibility", "content", "created_at", "updated_at")
    newest = [F.desc("updated_at"), F.col("id")]
    common = top_n(memories.filter(in_global_scope("only")), ["tenant_id"], newest, n_global)
    shown_global = requests.join(common, "tenant_id").select("session_id", F.lit(1).alias("section"), "id", F.col("updated_at").alias("at"), "content")
    local = memories.filter(in_global_scope("exclude"))
    asked = requests.select("tenant_id", "project").distinct()
    of_project = local.join(asked, "tenant_id").filter(
        F.col("project").isNull() | path_applies(F.col("project_path"), F.col("visibility"), F.col("project")))
    recent = top_n(of_project.withColumn("_p", F.coalesce("project", F.lit(""))), ["tenant_id", "_p"], newest, n_recent)
    shown_recent = requests.withColumn("_p", F.coalesce("project", F.lit(""))).drop("project").join(
        recent.drop("project"), ["tenant_id", "_p"]).select("session_id", F.lit(2).alias("section"), "id", F.col("updated_at").alias("at"), "content")
    seen = shown_global.unionByName(shown_recent)
    found = hits.withColumnRenamed("memory_id", "id").join(seen.select("session_id", "id"), ["session_id", "id"], "left_anti").join(
        memories.select("id", F.col("created_at").alias("at"), "content"), "id")
    lines = seen.withColumn("order", -F.unix_seconds("at").cast("double")).unionByName(
        found.select("session_id", F.lit(3).alias("section"), "id", "at", "content", (-F.col("score")).alias("order")))
    line = F.concat(F.lit("- ("), times.short_age(F.col("at"), as_of), F.lit(") "), "content")
    place = F.row_number().over(Window.partitionBy("session_id", "section").orderBy("order", "id"))
    sections = lines.select("session_id", "section", place.alias("_n"), line.alias("_line")).groupBy("session_id", "section").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_line"))), lambda r: r["_line"]), "\n").alias("_body"))
    title = F.when(F.col("section") == 1, TITLES[1]).when(F.col("section") == 2, TITLES[2]).otherwise(TITLES[3])
    bodies = sections.groupBy("session_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("section", F.concat(title, F.lit("\n"), "_body", F.lit("\n")).alias("t")))), lambda r: r["t"]), "\n").alias("_body"))
    profile = profiles.select("tenant_id", F.col("project").alias("_p"), F.col("content").alias("_profile"))
    whole = requests.withColumn("_p", F.coalesce("project", F.lit(""))).join(profile, ["tenant_id", "_p"], "left").join(bodies, "session_id", "left")
    head = F.when(strip(F.coalesce("_profile", F.lit(""))) != "", F.concat(strip(F.col("_profile")), F.lit("\n\n"))).otherwise("")
    text = F.concat(F.lit(f"[{mark}]\n\n"), head, F.coalesce(F.concat("_body", F.lit("\n")), F.lit("")), F.lit(f"[/{mark}]"))
    short = F.regexp_extract(F.substring(text, 1, limit), r"(?s)^(.*)\n", 1)
    cut = F.concat(F.when(short != "", short).otherwise(F.substring(text, 1, limit)), F.lit(f"\n…\n[/{mark}]"))
    return whole.select("session_id", F.when(F.char_length(text) > limit, cut).otherwise(text).alias("text"))
