"""Category tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CATEGORY_SCHEMA, DEFAULT_ALIASES, DEFAULT_CATEGORIES


def seed_categories(tenants: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Nine default categories for each tenant; rows that exist stay as they are. ``tenants``: tenant_id."""
    fields = [part.split() for part in CATEGORY_SCHEMA.split(", ")]
    packed = F.array(*[
        F.struct(*[F.lit(v).cast(kind).alias(name) for (name, kind), v in zip(fields, row)]) for row in DEFAULT_CATEGORIES])
    seeded = tenants.select("tenant_id").distinct().select("tenant_id", F.inline(packed))
    if existing is None:
        return seeded
    return existing.unionByName(seeded.join(existing.select("tenant_id", "name"), ["tenant_id", "name"], "left_anti"))


def seed_aliases(tenants: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    packed = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(t).alias("target")) for a, t in DEFAULT_ALIASES])
    seeded = tenants.select("tenant_id").distinct().select("tenant_id", F.inline(packed))
    if existing is None:
        return seeded
    return existing.unionByName(seeded.join(existing.select("tenant_id", "alias"), ["tenant_id", "alias"], "left_anti"))
