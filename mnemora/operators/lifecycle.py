"""Ageing of memories: decay, tiers, expiry, archiving, dormant preferences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, times
from ..functions.columns import compute_once
from ..functions.scoring import Decay


@dataclass(frozen=True)
class TierRules:
    """Thresholds of promotion and demotion."""

    working_access: int = 6
    working_strength: float = 0.4
    core_access: int = 10
    core_strength: float = 0.7
    core_importance: float = 0.8
    demote_strength: float = 0.2
    demote_age_days: float = 90.0


def decay_scores(memories: DataFrame, as_of, decay: Decay = Decay()) -> DataFrame:
    """Adds recency, frequency, intrinsic, raw and floored strength, and the stale flag."""
    return (
        memories.withColumn("recency", scoring.recency(F.col("importance"), as_of, decay))
        .withColumn("frequency", scoring.frequency())
        .withColumn("intrinsic", F.col("importance") * F.col("confidence"))
        .withColumn("raw_strength", scoring.raw_strength(as_of, decay))
        .withColumn("strength", scoring.strength(as_of, decay))
        .withColumn("stale", F.col("strength") < decay.stale_threshold)
    )


def judged_tier(as_of, decay: Decay = Decay(), rules: TierRules = TierRules()) -> Column:
    """Promotion looks at an importance raised by use, demotion at the raw strength.

    Only active rows are judged; others keep their tier.
    """
    lifted = F.least(F.lit(1.0), F.greatest(F.col("importance"), 0.5 + F.col("access_count") * 0.05))
    composite = scoring.strength(as_of, decay, lifted)
    idle = times.days_ago(F.coalesce("last_accessed_at", "created_at"), as_of)
    fades = (
        (F.col("visibility") != "private")
        & (scoring.raw_strength(as_of, decay) < rules.demote_strength)
        & (idle > rules.demote_age_days)
    )
    count, tier = F.col("access_count"), F.col("tier")
    to_working = (count >= rules.working_access) & (composite >= rules.working_strength)
    to_core = (
        (count >= rules.core_access) & (composite >= rules.core_strength) & (lifted >= rules.core_importance)
    )
    judged = (
        F.when((tier == "peripheral") & to_working, F.lit("working"))
        .when((tier == "working") & to_core, F.lit("core"))
        .when((tier == "working") & fades, F.lit("peripheral"))
        .when((tier == "core") & fades, F.lit("working"))
        .otherwise(tier)
    )
    return F.when(F.col("state") == "active", judged).otherwise(tier)


def evaluate_tiers(
    memories: DataFrame, as_of, decay: Decay = Decay(), rules: TierRules = TierRules()
) -> DataFrame:
    """Adds ``new_tier``."""
    return compute_once(memories, new_tier=judged_tier(as_of, decay, rules))


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "core", 2).when(tier == "working", 1).otherwise(0)


def append_tier_history(memories: DataFrame, as_of, reason: str = "auto evaluation") -> DataFrame:
    """Applies ``new_tier``: a changed row gets the tier and a history entry."""
    entry = F.struct(
        F.col("tier").alias("from"),
        F.col("new_tier").alias("to"),
        F.lit(reason).alias("reason"),
        times.moment(as_of).cast("string").alias("at"),
        F.col("access_count").cast("bigint").alias("access_count"),
    )
    history = F.coalesce(F.col("tier_history"), F.slice(F.array(entry), 1, 0))
    changed = F.col("tier") != F.col("new_tier")
    return memories.withColumn(
        "tier_history", F.when(changed, F.array_append(history, entry)).otherwise(F.col("tier_history"))
    ).withColumn("tier", F.col("new_tier")).drop("new_tier")


def tier_changes(memories: DataFrame, direction: str | None = None, search: str | None = None) -> DataFrame:
    """One row per history entry of active memories, with title and direction filter."""
    rows = (
        memories.filter(F.col("state") == "active")
        .select(
            "id",
            F.when(F.col("l0_abstract") == "", F.substring("content", 1, 40))
            .otherwise(F.col("l0_abstract")).alias("title"),
            F.inline("tier_history"),
        )
    )
    before, after = tier_rank(F.col("from")), tier_rank(F.col("to"))
    if direction == "promote":
        rows = rows.filter(before < after)
    elif direction == "demote":
        rows = rows.filter(before > after)
    if search is not None:
        haystack = F.lower(F.concat_ws(" ", F.col("id").cast("string"), "title", "from", "to", "reason"))
        rows = rows.filter(haystack.contains(search.lower()))
    return rows


def drop_history_entry(memories: DataFrame, removals: DataFrame) -> DataFrame:
    """Removes entries equal in from, to, at and reason. ``removals``: id, from, to, at, reason."""
    wanted = removals.groupBy("id").agg(F.collect_set(F.struct("from", "to", "at", "reason")).alias("_gone"))
    kept = F.filter(
        "tier_history",
        lambda e: ~F.array_contains(
            F.col("_gone"),
            F.struct(e["from"].alias("from"), e["to"].alias("to"), e["at"].alias("at"), e["reason"].alias("reason")),
        ),
    )
    return memories.join(wanted, "id", "left").withColumn(
        "tier_history", F.when(F.col("_gone").isNull(), F.col("tier_history")).otherwise(kept)
    ).drop("_gone")


def detect_ttl(text: Column) -> Column:
    """Days a text with a time word stays useful, else null; the first word group wins."""
    lower = F.lower(text)
    return (
        F.when(lower.contains("today") | lower.contains("今天"), F.lit(2))
        .when(lower.contains("tomorrow") | lower.contains("明天"), F.lit(2))
        .when(lower.contains("next week") | lower.contains("下周"), F.lit(10))
        .when(lower.contains("this month") | lower.contains("这个月"), F.lit(35))
    )


def is_expired(as_of) -> Column:
    end = F.unix_seconds("created_at") + detect_ttl(F.col("content")) * 86400
    return F.coalesce(end < F.unix_seconds(times.moment(as_of)), F.lit(False))


def expired(memories: DataFrame, as_of) -> DataFrame:
    return memories.filter(is_expired(as_of))


def archive_superseded(memories: DataFrame, as_of, after_days: int = 30) -> DataFrame:
    """Rows with a successor and older than ``after_days`` become archived."""
    age = times.seconds_between(F.col("created_at"), times.moment(as_of))
    old = F.col("superseded_by").isNotNull() & (age > after_days * 86400)
    return memories.withColumn("state", F.when(old, F.lit("archived")).otherwise(F.col("state"))).withColumn(
        "updated_at", F.when(old, times.moment(as_of)).otherwise(F.col("updated_at"))
    )


def stale(memories: DataFrame, as_of, decay: Decay = Decay(), protected_access: int = 5) -> DataFrame:
    """Active, not pinned, rarely used and faded rows."""
    return memories.filter(
        (F.col("state") == "active")
        & (F.col("memory_type") != "pinned")
        & (F.col("access_count") < protected_access)
        & (scoring.strength(as_of, decay) < decay.stale_threshold)
    )


def cap_per_space(rows: DataFrame, cap: int | None = 50) -> DataFrame:
    """At most ``cap`` rows of each space, lowest id first: the delete limit of one run. With None all."""
    if cap is None:
        return rows
    order = Window.partitionBy("space_id").orderBy("id")
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).drop("_n")


def decay_curve(memories: DataFrame, points: int = 90, decay: Decay = Decay()) -> DataFrame:
    """(id, day, strength) of every memory for days 0 .. points - 1, not below the tier floor."""
    rate, exponent = scoring.decay_rate(F.col("importance"), decay), scoring.beta(F.col("tier"), decay)
    return memories.select(
        "id",
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("day"),
        rate.alias("_rate"), exponent.alias("_beta"), scoring.floor(F.col("tier"), decay).alias("_floor"),
    ).select(
        "id", "day",
        F.greatest(F.exp(-F.col("_rate") * F.pow(F.col("day").cast("double"), "_beta")), "_floor").alias("strength"),
    )


def dormant_preferences(preferences: DataFrame, as_of, after_days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(preferences with idle ones dormant, changelog)."""
    idle = F.col("status").isin("active", "reinforce") & (
        times.seconds_between(F.col("last_reinforced_at"), times.moment(as_of)) > after_days * 86400
    )
    log = preferences.filter(idle).select(
        "tenant_id", F.col("id").alias("preference_id"), F.lit("dormant").alias("action"),
        F.col("status").alias("old_value"), F.lit("lifecycle").alias("source"),
    )
    changed = preferences.withColumn(
        "updated_at", F.when(idle, times.moment(as_of)).otherwise(F.col("updated_at"))
    ).withColumn("status", F.when(idle, F.lit("dormant")).otherwise(F.col("status")))
    return changed, log


def purge_preferences(preferences: DataFrame, as_of, after_days: int = 180) -> tuple[DataFrame, DataFrame]:
    """(preferences without long dormant ones, changelog)."""
    gone = (F.col("status") == "dormant") & (
        times.seconds_between(F.col("updated_at"), times.moment(as_of)) > after_days * 86400
    )
    log = preferences.filter(gone).select(
        "tenant_id", F.col("id").alias("preference_id"), F.lit("deleted").alias("action"),
        F.lit("dormant").alias("old_value"), F.lit("lifecycle_cleanup").alias("source"),
    )
    return preferences.filter(~gone), log
