"""Recent (hot) and older (cold) events: split by day and merged results."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.operators.rows import event_by_id
from newsloom.plans.filters import EventFilter, cut, day_range
from newsloom.schema import LIST_COLUMNS


def route(start: date, end: date, cutoff: date) -> str:
    """Which tier answers a window: 'hot', 'cold' or 'hybrid'."""
    if start >= cutoff:
        return "hot"
    return "cold" if end < cutoff else "hybrid"


def split_filter(f: EventFilter, cutoff: date) -> tuple[EventFilter, EventFilter]:
    """The hot and the cold part of a filter that spans the cutoff day."""
    return f.with_(start_date=cutoff), f.with_(end_date=cutoff - timedelta(days=1))


def both_tiers(hot: DataFrame, cold: DataFrame, cutoff: date) -> DataFrame:
    """One table of both tiers; the cold one may lack the list columns."""
    recent = hot.where(day_range(hot, cutoff, None))
    older = cold.where(day_range(cold, None, cutoff - timedelta(days=1)))
    merged = recent.unionByName(older, allowMissingColumns=True)
    return merged.withColumns(
        {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in LIST_COLUMNS}
    )


def event_from_tiers(hot: DataFrame, cold: DataFrame, event_id: int) -> DataFrame:
    """The event of the hot tier, else that of the cold tier, else no row."""
    found = event_by_id(hot, event_id).withColumn("tier", F.lit(0)).unionByName(
        event_by_id(cold, event_id).withColumn("tier", F.lit(1))
    )
    return found.orderBy("tier").limit(1).drop("tier")


def _weighted_mean(mean: str, weight: Column) -> Column:
    """Mean of daily means weighted by `weight`, days without a mean left out."""
    known = F.when(F.col(mean).isNotNull(), weight)
    return F.when(F.sum(known) > 0, F.sum(F.col(mean) * weight) / F.sum(known)).alias(mean)


def merge_daily_counts(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Days of both series added up; means weighted by the event counts."""
    return (
        hot.unionByName(cold)
        .groupBy("date")
        .agg(
            F.sum("count").alias("count"),
            _weighted_mean("avg_goldstein_scale", F.col("count")),
            F.sum("total_mentions").alias("total_mentions"),
            _weighted_mean("avg_tone", F.col("count")),
        )
        .orderBy("date")
    )


def daily_sums(rows: DataFrame) -> DataFrame:
    """Daily sums and counts, which merge without loss where means do not."""
    return rows.groupBy("SQLDATE").agg(
        F.count("*").alias("n"),
        F.sum("GoldsteinScale").alias("goldstein_sum"),
        F.count("GoldsteinScale").alias("goldstein_rows"),
        F.coalesce(F.sum("NumMentions"), F.lit(0)).alias("mentions"),
        F.sum("AvgTone").alias("tone_sum"),
        F.count("AvgTone").alias("tone_rows"),
    )


def merge_daily_sums(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Exact merge of `daily_sums` of both tiers."""
    total = hot.unionByName(cold).groupBy("SQLDATE").agg(
        *(F.sum(c).alias(c) for c in hot.columns if c != "SQLDATE")
    )

    def mean(name: str) -> Column:
        return F.when(F.col(f"{name}_rows") > 0, F.col(f"{name}_sum") / F.col(f"{name}_rows"))

    return total.select(
        "SQLDATE",
        F.col("n").alias("count"),
        mean("goldstein").alias("avg_goldstein_scale"),
        F.col("mentions").alias("total_mentions"),
        mean("tone").alias("avg_tone"),
    ).orderBy("SQLDATE")


def merge_grids(hot: DataFrame, cold: DataFrame, limit: int | None = None) -> DataFrame:
    """Map cells of both tiers, fullest first; a merged cell has no country.

    Both grids must be whole (a filter without limit): a cell that one tier has cut off would
    come out too small. `limit` cuts the merged cells.
    """
    cells = hot.unionByName(cold, allowMissingColumns=True).groupBy("lat", "lon").agg(
        F.sum("intensity").cast("double").alias("intensity")
    )
    return cut(cells.orderBy(F.desc("intensity"), "lat", "lon"), limit)


def merge_rows(hot: DataFrame, cold: DataFrame, limit: int) -> DataFrame:
    """Listed rows of both tiers, newest first."""
    rows = hot.unionByName(cold, allowMissingColumns=True)
    return rows.orderBy(F.desc("sql_date"), F.desc("global_event_id")).limit(limit)
