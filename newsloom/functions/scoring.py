"""Risk score, threat bands and conflict measures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CONFLICT_CLASSES = (3, 4)


def is_conflict() -> Column:
    return F.col("QuadClass").isin(*CONFLICT_CLASSES)


def conflict_count() -> Column:
    return F.count_if(is_conflict())


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _clamp_percent(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def risk_score(conflict_ratio: Column, avg_goldstein: Column, avg_tone: Column) -> Column:
    """Whole-number risk 0-100: conflict share, Goldstein and tone, half-even rounded."""
    conflict = F.coalesce(conflict_ratio, F.lit(0.0)) * 100
    goldstein = _clamp_percent((-F.coalesce(avg_goldstein, F.lit(0.0)) + 10) / 20 * 100)
    tone = _clamp_percent((-F.coalesce(avg_tone, F.lit(0.0)) + 30) / 60 * 100)
    return F.bround(conflict * 0.4 + goldstein * 0.35 + tone * 0.25, 0).cast("int")


def threat_band(score: Column) -> Column:
    return (
        F.when(score > 70, "CRITICAL")
        .when(score > 50, "ELEVATED")
        .when(score > 30, "MODERATE")
        .otherwise("LOW")
    )


def goldstein_percent(goldstein: Column) -> Column:
    """Goldstein scale as a 0-100 gauge position."""
    return _clamp_percent((F.coalesce(goldstein, F.lit(0.0)) + 10) / 20 * 100)
