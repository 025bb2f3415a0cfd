"""Time helpers: every operator takes ``as_of`` instead of reading the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400.0


def moment(as_of) -> Column:
    """``as_of`` (epoch seconds, datetime, text or Column) as a timestamp Column."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, (int, float)):
        return F.timestamp_seconds(F.lit(as_of))
    if isinstance(as_of, dt.datetime):
        return F.lit(as_of)
    return F.to_timestamp(F.lit(as_of))


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_seconds(end) - F.unix_seconds(start)


def days_ago(stamp: Column, as_of) -> Column:
    """Days from ``stamp`` to ``as_of`` in whole seconds, at least 0; 0 when the stamp is missing."""
    days = seconds_between(stamp, moment(as_of)) / F.lit(DAY)
    return F.coalesce(F.greatest(days, F.lit(0.0)), F.lit(0.0))


def short_age(stamp: Column, as_of) -> Column:
    """``5m ago``, ``3h ago``, ``4d ago``, ``2mo ago``; ``unknown`` when missing."""
    minutes = F.floor(seconds_between(stamp, moment(as_of)) / 60)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return (
        F.when(stamp.isNull(), F.lit("unknown"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days < 30, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit("mo ago")))
    )


def worded_age(stamp: Column, as_of) -> Column:
    """``today``, ``1 day ago``, ``12 days ago``, ``3 months ago``, ``2 years ago``."""
    days = F.floor(seconds_between(stamp, moment(as_of)) / F.lit(DAY))
    months = F.floor(days / 30)
    years = F.floor(months / 12)

    def worded(count: Column, unit: str) -> Column:
        return F.when(count == 1, F.lit(f"1 {unit} ago")).otherwise(
            F.concat(count.cast("string"), F.lit(f" {unit}s ago"))
        )

    return (
        F.when(stamp.isNull(), F.lit("unknown"))
        .when(days < 1, F.lit("today"))
        .when(days < 30, worded(days, "day"))
        .when(months < 12, worded(months, "month"))
        .otherwise(worded(years, "year"))
    )
