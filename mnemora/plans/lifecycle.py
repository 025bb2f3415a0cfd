"""One maintenance run over all spaces and tenants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import compute_once
from ..functions.scoring import Decay
from ..operators import lifecycle as ops


@dataclass
class LifecycleResult:
    memories: DataFrame
    deleted: DataFrame
    preferences: DataFrame | None
    changelog: DataFrame | None
    summary: DataFrame


def lifecycle_run(
    memories: DataFrame,
    as_of,
    preferences: DataFrame | None = None,
    decay: Decay = Decay(),
    rules: ops.TierRules = ops.TierRules(),
    delete_cap: int = 50,
) -> LifecycleResult:
    """Tiers, then expiry, archiving and the capped stale delete; dormant preferences at the end.

    Memories pass through one projection with flags; only the capped delete needs a shuffle (by space).
    """
    tiered = compute_once(memories, new_tier=ops.judged_tier(as_of, decay, rules), _expired=ops.is_expired(as_of))
    tiered = ops.append_tier_history(tiered.withColumn("_moved", F.col("tier") != F.col("new_tier")), as_of)
    aged = ops.archive_superseded(tiered.withColumn("_was", F.col("state")), as_of)
    aged = aged.withColumn("_archived", (F.col("_was") != F.col("state"))).drop("_was")
    faded = ops.cap_per_space(ops.stale(aged.filter(~F.col("_expired")), as_of, decay), delete_cap)
    marked = aged.join(faded.select("id", F.lit(True).alias("_stale")), "id", "left").withColumn(
        "_stale", F.coalesce("_stale", F.lit(False))
    )
    gone = F.col("_expired") | F.col("_stale")
    flags = ["_moved", "_expired", "_archived", "_stale"]
    summary = marked.groupBy("space_id").agg(
        F.count_if(F.col("_moved")).alias("tier_changes"),
        F.count_if(F.col("_expired")).alias("expired"),
        F.count_if(F.col("_archived") & ~F.col("_expired")).alias("archived"),
        F.count_if(F.col("_stale")).alias("stale_deleted"),
    )
    changed = log = None
    if preferences is not None:
        changed, dormant_log = ops.dormant_preferences(preferences, as_of)
        changed, purge_log = ops.purge_preferences(changed, as_of)
        log = dormant_log.unionByName(purge_log)
    return LifecycleResult(
        memories=marked.filter(~gone).drop(*flags),
        deleted=marked.filter(gone).select("id", "space_id", "_expired", "_stale"),
        preferences=changed,
        changelog=log,
        summary=summary,
    )
