"""Decay, admission and importance formulas as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import times


@dataclass(frozen=True)
class Decay:
    """Fixed values of the Weibull decay model."""

    half_life_days: float = 30.0
    recency_weight: float = 0.4
    frequency_weight: float = 0.3
    intrinsic_weight: float = 0.3
    importance_modulation: float = 1.5
    stale_threshold: float = 0.3
    search_boost_min: float = 0.3
    beta_core: float = 0.8
    beta_working: float = 1.0
    beta_peripheral: float = 1.3
    floor_core: float = 0.9
    floor_working: float = 0.7
    floor_peripheral: float = 0.5


def by_tier(tier: Column, core, working, peripheral) -> Column:
    return (
        F.when(tier == "core", F.lit(core))
        .when(tier == "working", F.lit(working))
        .otherwise(F.lit(peripheral))
    )


def beta(tier: Column, decay: Decay) -> Column:
    return by_tier(tier, decay.beta_core, decay.beta_working, decay.beta_peripheral)


def floor(tier: Column, decay: Decay) -> Column:
    return by_tier(tier, decay.floor_core, decay.floor_working, decay.floor_peripheral)


def decay_rate(importance: Column, decay: Decay) -> Column:
    """ln 2 over the half life that importance stretches."""
    return F.lit(math.log(2.0)) / (F.lit(decay.half_life_days) * F.exp(F.lit(decay.importance_modulation) * importance))


def recency(importance: Column, as_of, decay: Decay) -> Column:
    days = times.days_ago(F.coalesce("last_accessed_at", "created_at"), as_of)
    return F.exp(-decay_rate(importance, decay) * F.pow(days, beta(F.col("tier"), decay)))


def frequency() -> Column:
    """Saturating access count, halved at most when accesses lie far apart."""
    count = F.col("access_count")
    base = 1.0 - F.exp(-count / 5.0)
    span = times.seconds_between(F.col("created_at"), F.coalesce("last_accessed_at", "created_at")) / F.lit(times.DAY)
    gap = F.greatest(span, F.lit(0.0)) / (count - 1)
    return F.when(count > 1, base * (0.5 + 0.5 * F.exp(-gap / 30.0))).otherwise(base)


def raw_strength(as_of, decay: Decay = Decay(), importance: Column | None = None) -> Column:
    importance = F.col("importance") if importance is None else importance
    return (
        F.lit(decay.recency_weight) * recency(importance, as_of, decay)
        + F.lit(decay.frequency_weight) * frequency()
        + F.lit(decay.intrinsic_weight) * importance * F.col("confidence")
    )


def strength(as_of, decay: Decay = Decay(), importance: Column | None = None) -> Column:
    """Composite of recency, frequency and intrinsic value, not below the floor of the tier."""
    return F.greatest(raw_strength(as_of, decay, importance), floor(F.col("tier"), decay))


def search_boost(as_of, decay: Decay = Decay()) -> Column:
    low = F.lit(decay.search_boost_min)
    return low + (1.0 - low) * strength(as_of, decay)


def fact_importance(base: Column, quality: Column) -> Column:
    """Category base blended with quality, within [0.1, 1]."""
    return F.least(F.greatest(base * 0.6 + quality * 0.4, F.lit(0.1)), F.lit(1.0))
