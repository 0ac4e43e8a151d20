"""Scores, signals and classes of the findings, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def trajectory(now: Column, weekly: Column, lifetime: Column) -> Column:
    """new or resurfacing without a baseline, else rising, falling or steady by the factor 1.5."""
    growth = F.try_divide(now.cast("double"), weekly)
    return (
        F.when(weekly.isNull() | (weekly == 0), F.when(lifetime > now, "resurfacing").otherwise("new"))
        .when(growth >= 1.5, "rising")
        .when(growth <= 1 / 1.5, "falling")
        .otherwise("steady")
    )


def signal(carrying: Column, concern: Column, supportive: Column, base_concern: Column) -> Column:
    """positive, concern, escalating or coverage, the first that holds."""
    return (
        F.when(carrying == 0, "coverage")
        .when((supportive >= 0.5) & (supportive > concern), "positive")
        .when(concern >= 0.5, "concern")
        .when((concern >= 0.2) & (concern - base_concern >= 0.15), "escalating")
        .otherwise("coverage")
    )


def stance_contribution(concern: Column, base_concern: Column) -> Column:
    concern = F.coalesce(concern, F.lit(0.0))
    return 4 * concern + 5 * F.greatest(F.lit(0.0), concern - F.coalesce(base_concern, concern))


def growth_contribution(growth: Column) -> Column:
    return 2 * F.least(F.coalesce(growth, F.lit(4.0)), F.lit(4.0))


def rank_score(count: Column, voices: Column, districts: Column, growth: Column, stance: Column, seasonal: Column) -> Column:
    """A bounded sum, times the season's multiplier."""
    bounded = F.least(count, F.lit(20)) * 0.5 + F.least(voices, F.lit(10)) + F.least(districts, F.lit(8)) * 1.5
    return (bounded + growth_contribution(growth) + stance) * seasonal


def category(count: Column, districts: Column, source_types: Column) -> Column:
    return F.when((count >= 6) & (districts >= 2) & (source_types >= 3), "emerging").when(count >= 2, "watch")


def finding_confidence(voices: Column, source_types: Column) -> Column:
    return F.least(F.lit(0.9), 0.35 + 0.04 * voices + 0.06 * source_types)


def in_season(day: Column, start_md: Column, end_md: Column) -> Column:
    """Whether a date's month * 100 + day is in a window that may go round the year's end."""
    md = F.month(day) * 100 + F.dayofmonth(day)
    return F.when(start_md <= end_md, (md >= start_md) & (md <= end_md)).otherwise((md >= start_md) | (md <= end_md))


def shade(balance: Column) -> Column:
    """Step 1 to 3 of a map's shade, with the sign of the balance; 0 without one."""
    size = F.abs(balance)
    step = F.when(size < 0.34, 1).when(size < 0.67, 2).otherwise(3)
    return F.when(balance.isNull() | (balance == 0), 0).otherwise(F.signum(balance).cast("int") * step)
