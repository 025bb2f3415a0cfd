"""Preference profile: validation, induction, selection and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times
from ..functions.columns import strip, two_digits
from . import set_join
from .ranking import pack_budget, top_n

# Preference slots; others are named custom:<name>.
SLOTS = [
    "communication_style", "tone", "code_style", "error_handling", "naming_convention", "testing_strategy",
    "workflow_preference", "commit_style", "emoji_preference", "self_reference", "address_style", "language",
    "framework_preference", "preferred_tools",
]


def valid_slot():
    return F.col("slot").isin(*SLOTS) | F.rlike("slot", F.lit("^custom:[a-z0-9_]+$"))


def valid_preferences(inducted: DataFrame) -> DataFrame:
    return inducted.filter(
        valid_slot() & F.col("confidence").between(0.0, 1.0) & F.col("scope").isin("project", "global")
        & (strip(F.col("value")) != "") & (F.char_length("value") <= 150))


def apply_induction(preferences: DataFrame, inducted: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reinforced, created, changelog).

    A valid item reinforces the most confident preference of its tenant and slot with the same value or a keyword
    overlap above 0.6; otherwise it becomes a preference. Equal values meet by an equi join, similar ones by the set
    join, so a slot that many preferences share is never paired out.
    """
    items = valid_preferences(inducted)
    by = ["tenant_id", "slot"]
    live = preferences.filter(F.col("status") != "deleted")
    strongest = F.struct((-F.col("confidence")).alias("_rank"), F.col("id"))
    same = live.groupBy(*by, "value").agg(F.min(strongest).alias("_best"))
    exact = items.join(same, [*by, "value"]).select("item_id", "_best")

    def keyed(df: DataFrame) -> DataFrame:
        tokens = df.withColumn("tokens", tx.preference_keywords(F.col("value"))).filter(F.size("tokens") > 0)
        return tokens.withColumn("set_key", set_join.set_key(F.col("tokens")))

    new, old = keyed(items), keyed(live)
    order = ("_rank", "id")
    ranked = old.withColumn("_rank", -F.col("confidence"))
    close = set_join.similar_sets(set_join.distinct_sets(new, by), set_join.distinct_sets(ranked, by, order), by, 0.6, pick="first", order=order)
    per_set = close.select(*by, F.col("left_key").alias("set_key"), F.struct("_rank", "id").alias("_best"))
    similar = new.join(per_set, [*by, "set_key"]).select("item_id", "_best")
    matched = exact.unionByName(similar).groupBy("item_id").agg(F.min("_best").alias("_best")).select(
        "item_id", F.col("_best.id").alias("preference_id"))
    hits = matched.groupBy(F.col("preference_id").alias("id")).agg(F.count("*").alias("hits"))
    stamp = times.moment(as_of)
    reinforced = live.join(hits, "id").select(
        "id", "tenant_id", "slot", F.col("confidence").alias("old_confidence"),
        F.least(F.col("confidence") + F.col("hits") * 0.15, F.lit(0.95)).alias("confidence"), "hits", stamp.alias("updated_at"))
    created = items.join(matched.select("item_id"), "item_id", "left_anti").select(
        F.sha2(F.concat_ws("/", "tenant_id", F.col("item_id").cast("string")), 256).alias("id"), "item_id", "tenant_id", "slot", "value",
        "confidence", "scope", "project_path", F.lit("observed").alias("source"), F.lit("active").alias("status"),
        stamp.alias("last_reinforced_at"))
    log = reinforced.select(
        "tenant_id", F.col("id").cast("string").alias("preference_id"), F.lit("reinforced").alias("action"),
        F.format_string("confidence: %s→%s", two_digits(F.col("old_confidence")), two_digits(F.col("confidence"))).alias("new_value")
    ).unionByName(created.select("tenant_id", F.col("id").alias("preference_id"), F.lit("created").alias("action"), F.col("value").alias("new_value")))
    return reinforced, created, log


def induction_eligible(tenants: DataFrame, runs: DataFrame, locks: DataFrame, candidates: DataFrame, as_of,
                       cooldown: int = 600, threshold: int = 5) -> DataFrame:
    """(tenant_id, reason, eligible). ``tenants``: tenant_id, enabled. ``locks``: tenant_id, expires_at."""
    now = times.moment(as_of)
    last = runs.filter(F.col("status") != "skipped").groupBy("tenant_id").agg(F.max("started_at").alias("_last"))
    held = locks.filter(F.col("expires_at") > now).select("tenant_id", F.lit(True).alias("_held")).distinct()
    texts = candidates.groupBy("tenant_id").agg(F.count("*").alias("_texts"))
    joined = tenants.join(last, "tenant_id", "left").join(held, "tenant_id", "left").join(texts, "tenant_id", "left")
    elapsed = times.seconds_between(F.col("_last"), now)
    reason = (
        F.when(~F.col("enabled"), F.lit("disabled")).when(F.col("_held"), F.lit("locked"))
        .when((elapsed >= 0) & (elapsed < cooldown), F.lit("cooldown"))
        .when(F.coalesce("_texts", F.lit(0)) < threshold, F.lit("not_enough_candidates")).otherwise(F.lit("ok"))
    )
    return joined.select("tenant_id", reason.alias("reason"), (reason == "ok").alias("eligible"))


def preferences_for(preferences: DataFrame, requests: DataFrame) -> DataFrame:
    """Preferences a tenant and project see, most confident first by ``place``. ``requests``: tenant_id, project."""
    live = preferences.filter(F.col("status") != "deleted")
    everywhere = requests.join(live.filter("scope = 'global'"), "tenant_id")
    local = requests.join(
        live.filter("scope = 'project'").withColumn("project", F.col("project_path")), ["tenant_id", "project"])
    return everywhere.unionByName(local)


def profile_text(preferences: DataFrame, requests: DataFrame, most_global: int = 20, most_project: int = 10,
                 budget: int = 3000) -> DataFrame:
    """(tenant_id, project, content, preferences, tokens): active preferences as lines within the byte budget."""
    live = preferences.filter(F.col("status") == "active")
    order = [F.desc("confidence"), F.col("id")]
    common = top_n(live.filter("scope = 'global'"), ["tenant_id"], order, most_global)
    own = top_n(live.filter("scope = 'project'"), ["tenant_id", "project_path"], order, most_project).withColumn(
        "project", F.col("project_path"))
    shown = requests.join(common, "tenant_id").unionByName(requests.join(own, ["tenant_id", "project"])).withColumn(
        "project", F.coalesce("project", F.lit("")))
    by = ["tenant_id", "project"]
    kept = pack_budget(shown, by, budget)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    line = F.concat(F.lit("- "), "slot", F.lit(": "), "value")
    texts = kept.select(*by, place.alias("_n"), line.alias("_line")).groupBy(*by).agg(
        F.count("*").alias("preferences"), F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("_n", "_line"))), lambda r: r["_line"]), "\n").alias("_lines"))
    content = F.coalesce(F.concat(F.lit("## User Profile\n"), "_lines"), F.lit(""))
    asked = requests.select("tenant_id", F.coalesce("project", F.lit("")).alias("project")).distinct()
    return asked.join(texts, by, "left").select(
        *by, content.alias("content"), F.coalesce("preferences", F.lit(0)).alias("preferences"),
        F.floor(F.octet_length(content) / 4).alias("tokens"))


def profile_snapshot(preferences: DataFrame, part_rows: int = 1000) -> DataFrame:
    """(tenant_id, part, preference_count, snapshot): JSON of all rows, in parts, so a large profile is many rows."""
    counts = preferences.groupBy("tenant_id").agg(F.count("*").alias("preference_count"))
    parts = F.ceil(F.col("preference_count") / part_rows)
    fields = [c for c in preferences.columns if c != "tenant_id"]
    rows = preferences.join(counts, "tenant_id").withColumn("part", F.pmod(F.xxhash64("id"), parts))
    return rows.groupBy("tenant_id", "part", "preference_count").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias("snapshot"))


def upsert_preferences(preferences: DataFrame, edits: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(preferences, changelog). ``edits``: op (create, update, delete), id, and the columns of a preference.

    Null fields of an update leave the row alone; a delete marks the row. Updates and deletes need a stored row.
    """
    stamp = times.moment(as_of)
    fields = ["slot", "value", "confidence", "scope", "project_path", "status"]
    made = edits.filter((F.col("op") == "create") & valid_slot() & (strip(F.col("value")) != ""))
    inserted = made.select(
        "id", "tenant_id", "slot", "value", F.coalesce("confidence", F.lit(0.9)).alias("confidence"),
        F.when(F.col("scope") == "project", F.lit("project")).otherwise(F.lit("global")).alias("scope"), "project_path",
        F.lit("active").alias("status"), stamp.alias("updated_at"))
    wanted = edits.filter("op <> 'create'").select("id", "op", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = preferences.join(wanted, "id", "left")
    for f in fields:
        joined = joined.withColumn(f"_old_{f}", F.col(f)).withColumn(
            f, F.when(F.col("op") == "update", F.coalesce(f"_{f}", f)).otherwise(F.col(f)))
    joined = joined.withColumn("status", F.when(F.col("op") == "delete", F.lit("deleted")).otherwise(F.col("status")))
    joined = joined.withColumn("updated_at", F.when(F.col("op").isNotNull(), stamp).otherwise(F.col("updated_at")))
    log = joined.filter(F.col("op").isNotNull()).select(
        "tenant_id", F.col("id").alias("preference_id"), F.concat("op", F.lit("d")).alias("action"),
        F.col("_old_value").alias("old_value"), F.when(F.col("op") == "update", F.col("value")).alias("new_value"),
    ).unionByName(inserted.select(
        "tenant_id", F.col("id").alias("preference_id"), F.lit("created").alias("action"),
        F.lit(None).cast("string").alias("old_value"), F.col("value").alias("new_value")))
    columns = ["id", "tenant_id", *fields, "updated_at"]
    return joined.select(*columns).unionByName(inserted.select(*columns)), log
