"""Counts and averages by day, country, class, place and theme."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from newsloom.functions.dates import number_day_col
from newsloom.functions.scoring import conflict_count, is_conflict, ratio
from newsloom.plans.filters import (
    EventFilter,
    cut,
    days_between,
    has_country,
    in_box,
    in_country,
    select_events,
)
from newsloom.schema import THEME_CATEGORIES

COUNTRY = "ActionGeo_CountryCode"
FEATURES = ("event_count", "conflict_ratio", "avg_goldstein", "avg_tone", "num_mentions_sum")


def daily_series(rows: DataFrame, *keys: str) -> DataFrame:
    """Events, mean Goldstein, mentions and mean tone per day and `keys`."""
    daily = rows.groupBy(*keys, "SQLDATE").agg(
        F.count("*").alias("count"),
        F.avg("GoldsteinScale").alias("avg_goldstein_scale"),
        F.coalesce(F.sum("NumMentions"), F.lit(0)).alias("total_mentions"),
        F.avg("AvgTone").alias("avg_tone"),
    )
    return daily.select(
        *keys,
        number_day_col(F.col("SQLDATE")).alias("date"),
        "count",
        "avg_goldstein_scale",
        "total_mentions",
        "avg_tone",
    )


def daily_counts(events: DataFrame, f: EventFilter, places: DataFrame | None = None) -> DataFrame:
    return daily_series(select_events(events, f, places)).orderBy("date")


def daily_trend(events: DataFrame, f: EventFilter, places: DataFrame | None = None) -> DataFrame:
    """Per day all events and those of class 3 or higher."""
    rows = select_events(events, f, places)
    daily = rows.groupBy("SQLDATE").agg(
        F.count("*").alias("total"), F.count_if(F.col("QuadClass") >= 3).alias("conflict")
    )
    text = F.date_format(number_day_col(F.col("SQLDATE")), "yyyy-MM-dd")
    return daily.orderBy("SQLDATE").select(text.alias("date"), "total", "conflict")


def last_days(series: DataFrame, days: int = 14) -> DataFrame:
    """The newest rows of a daily series, oldest first."""
    return series.orderBy(F.desc("date")).limit(days).orderBy("date")


def country_conflict_daily(
    events: DataFrame, days: int = 90, anchor: date | None = None, conflict_only: bool = True
) -> DataFrame:
    """Daily series of every country over the last days, for forecasting."""
    rows = events.where(days_between(events, -days, 1, anchor)).where(has_country())
    if conflict_only:
        rows = rows.where(is_conflict())
    return daily_series(rows.withColumnRenamed(COUNTRY, "country_code"), "country_code")


def country_day_features(
    events: DataFrame, days: int = 90, anchor: date | None = None
) -> DataFrame:
    """Five measures per country and day."""
    rows = events.where(days_between(events, -days, 1, anchor)).where(has_country())
    return rows.groupBy(F.col(COUNTRY).alias("country_code"), "SQLDATE").agg(
        F.count("*").alias("event_count"),
        F.avg(F.when(is_conflict(), 1.0).otherwise(0.0)).alias("conflict_ratio"),
        F.avg("GoldsteinScale").alias("avg_goldstein"),
        F.avg("AvgTone").alias("avg_tone"),
        F.sum("NumMentions").alias("num_mentions_sum"),
    )


def top_countries(
    events: DataFrame, days: int = 7, limit: int = 30, anchor: date | None = None
) -> DataFrame:
    rows = events.where(days_between(events, -days, 1, anchor)).where(has_country())
    counts = rows.groupBy(F.col(COUNTRY).alias("country_code")).agg(F.count("*").alias("event_count"))
    return counts.orderBy(F.desc("event_count"), "country_code").limit(limit)


def country_volumes(
    events: DataFrame, days: int, limit: int = 50, anchor: date | None = None
) -> DataFrame:
    """Busiest countries since `days` days ago."""
    rows = events.where(days_between(events, -days, 1, anchor))
    stats = rows.groupBy(F.col(COUNTRY).alias("country_code")).agg(
        F.count("*").alias("event_count"),
        F.avg("GoldsteinScale").alias("avg_goldstein"),
        F.avg("AvgTone").alias("avg_tone"),
    )
    return stats.orderBy(F.desc("event_count"), "country_code").limit(limit)


def quad_class_volumes(events: DataFrame, days: int = 7, anchor: date | None = None) -> DataFrame:
    rows = events.where(days_between(events, -days, 1, anchor))
    return rows.groupBy(F.col("QuadClass").alias("quad_class")).agg(
        F.count("*").alias("event_count"), F.avg("GoldsteinScale").alias("avg_goldstein")
    )


def conflict_ratios(
    events: DataFrame, days: int = 30, more_than: int = 10, anchor: date | None = None
) -> DataFrame:
    """Conflict share of every country with enough events, highest first."""
    rows = events.where(days_between(events, -days, 1, anchor))
    stats = rows.groupBy(F.col(COUNTRY).alias("country_code")).agg(
        F.count("*").alias("event_count"),
        conflict_count().alias("conflicts"),
        F.avg("GoldsteinScale").alias("avg_goldstein"),
        F.avg("AvgTone").alias("avg_tone"),
        F.sum("NumMentions").alias("total_mentions"),
    )
    stats = stats.where(F.col("event_count") > more_than)
    return stats.select(
        "country_code",
        ratio(F.col("conflicts"), F.col("event_count")).alias("conflict_ratio"),
        "avg_goldstein",
        "avg_tone",
        "total_mentions",
    ).orderBy(F.desc("conflict_ratio"), "country_code")


def top_conflict_series(
    events: DataFrame, days: int = 90, anchor: date | None = None
) -> DataFrame:
    """Daily conflict counts of the country with most conflict events."""
    rows = events.where(days_between(events, -days, 1, anchor)).where(is_conflict())
    most = (
        rows.where(F.col(COUNTRY).isNotNull())
        .groupBy(COUNTRY)
        .count()
        .orderBy(F.desc("count"), COUNTRY)
        .limit(1)
        .select(COUNTRY)
        .scalar()
    )
    series = rows.where(F.col(COUNTRY) == most).groupBy("SQLDATE").agg(F.count("*").alias("y"))
    return series.select(number_day_col(F.col("SQLDATE")).alias("ds"), "y").orderBy("ds")


def map_grid(
    events: DataFrame,
    box: dict[str, float],
    f: EventFilter,
    digits: int = 2,
    places: DataFrame | None = None,
    normalize: bool = True,
) -> DataFrame:
    """Events per rounded map cell and the most frequent country of the cell.

    Counts per cell and country come first, so the cell's own shuffle carries one row
    per pair however many events a cell holds.
    """
    rows = select_events(events, f.with_(country_code=None), places, in_box(**box, normalize=normalize))
    pairs = rows.groupBy(
        F.round("ActionGeo_Lat", digits).alias("lat"),
        F.round("ActionGeo_Long", digits).alias("lon"),
        F.col(COUNTRY).alias("cell_country"),
    ).agg(F.count("*").alias("n"))
    rank = F.when(F.col("cell_country").isNotNull(), F.struct(-F.col("n"), F.col("cell_country")))
    cells = pairs.groupBy("lat", "lon").agg(
        F.min_by("cell_country", rank).alias("country_code"), F.sum("n").alias("intensity")
    )
    return cut(cells.orderBy(F.desc("intensity"), "lat", "lon"), f.limit)


def theme_category_counts(
    events: DataFrame, days: int = 7, anchor: date | None = None
) -> DataFrame:
    """Theme mentions per category; a theme counts for the first category it fits.

    Themes are counted first and only the distinct ones are classified.
    """
    rows = events.where(days_between(events, -days, 1, anchor)).where(F.size("themes") > 0)
    themes = rows.select(F.explode("themes").alias("theme")).groupBy("theme").count()
    name = F.upper("theme")
    category = F.lit(None).cast("string")
    for known, tokens in reversed(THEME_CATEGORIES.items()):
        fits = F.lit(False)
        for token in tokens:
            fits |= name.contains(token)
        category = F.when(fits, known).otherwise(category)
    counts = themes.groupBy(category.alias("category")).agg(F.sum("count").alias("n"))
    known = events.sparkSession.createDataFrame([(c,) for c in THEME_CATEGORIES], "category string")
    return known.join(counts, "category", "left").select(
        "category", F.coalesce("n", F.lit(0)).alias("event_count")
    )


def ingestion_stats(events: DataFrame) -> DataFrame:
    """Rows, distinct days and newest day of the table."""
    daily = events.groupBy("SQLDATE").agg(F.count("*").alias("n"))
    stats = daily.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count("SQLDATE").alias("coverage_days"),
        F.max("SQLDATE").alias("newest"),
    )
    newest = F.date_format(number_day_col(F.col("newest")), "yyyy-MM-dd'T'HH:mm:ss")
    return stats.select("total_rows", "coverage_days", newest.alias("last_updated_at"))


def country_series(events: DataFrame, country_code: str, f: EventFilter, days: int = 14) -> DataFrame:
    """Newest days of one country's series."""
    return last_days(daily_series(select_events(events, f).where(in_country(country_code))), days)
