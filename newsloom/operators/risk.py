"""Risk, threat, change and spike reports per country."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from newsloom.functions.scoring import conflict_count, is_conflict, ratio, risk_score, threat_band
from newsloom.plans.filters import (
    EventFilter,
    anchor_number,
    cut,
    days_between,
    has_country,
    select_events,
)
from newsloom.sources.lookups import with_country_names

COUNTRY = "ActionGeo_CountryCode"


def _country_stats(rows: DataFrame) -> DataFrame:
    stats = rows.groupBy(F.col(COUNTRY).alias("country_code")).agg(
        F.count("*").alias("total_events"),
        conflict_count().alias("conflicts"),
        F.avg("GoldsteinScale").alias("avg_goldstein"),
        F.avg("AvgTone").alias("avg_tone"),
        F.sum("AvgTone").alias("tone_sum"),
        F.count("AvgTone").alias("tone_rows"),
    )
    return stats.withColumn("conflict_ratio", ratio(F.col("conflicts"), F.col("total_events")))


def country_risk(
    events: DataFrame, country_code: str, f: EventFilter, places: DataFrame | None = None
) -> DataFrame:
    """One row of risk inputs and the score; zeros for a country without events."""
    rows = select_events(events, f.with_(geo_country=country_code, country_code=None), places)
    total = rows.agg(
        F.count("*").alias("total_events"),
        conflict_count().alias("conflicts"),
        F.avg("GoldsteinScale").alias("avg_goldstein"),
        F.avg("AvgTone").alias("avg_tone"),
        F.coalesce(F.sum("NumMentions"), F.lit(0)).alias("total_mentions"),
    ).withColumn("conflict_ratio", ratio(F.col("conflicts"), F.col("total_events")))
    score = risk_score(F.col("conflict_ratio"), F.col("avg_goldstein"), F.col("avg_tone"))
    return total.select(
        F.lit(country_code.upper()).alias("country_code"),
        "total_events",
        "conflict_ratio",
        "avg_goldstein",
        "avg_tone",
        "total_mentions",
        score.alias("score"),
    )


def global_pulse(
    events: DataFrame,
    f: EventFilter,
    names: DataFrame,
    min_tone_events: int = 10,
    places: DataFrame | None = None,
) -> DataFrame:
    """World totals with the busiest and the most hostile country, in one scan."""
    per_country = _country_stats(select_events(events, f.with_(country_code=None), places, has_country()))
    code = F.col("country_code")
    hostile = F.when(F.col("tone_rows") >= min_tone_events, F.struct("avg_tone", code))
    pulse = per_country.agg(
        F.coalesce(F.sum("total_events"), F.lit(0)).alias("total_events"),
        F.min_by(code, F.struct(-F.col("total_events"), code)).alias("most_active_country"),
        F.max("total_events").alias("most_active_count"),
        F.min_by(code, hostile).alias("most_hostile_country"),
        F.sum("tone_sum").alias("tone_sum"),
        F.sum("tone_rows").alias("tone_rows"),
        F.sum("conflicts").alias("conflicts"),
    )
    pulse = with_country_names(pulse, names, "most_active_country", "most_active")
    pulse = with_country_names(pulse, names, "most_hostile_country", "most_hostile")
    return pulse.select(
        "total_events",
        "most_active_country",
        "most_active_display",
        F.coalesce("most_active_count", F.lit(0)).alias("most_active_count"),
        "most_hostile_country",
        "most_hostile_display",
        F.when(F.col("tone_rows") > 0, F.col("tone_sum") / F.col("tone_rows")).alias("avg_global_tone"),
        ratio(F.col("conflicts"), F.col("total_events")).alias("global_conflict_ratio"),
    )


def top_threats(
    events: DataFrame,
    f: EventFilter,
    names: DataFrame,
    limit: int | None = 5,
    candidates: int | None = None,
    places: DataFrame | None = None,
) -> DataFrame:
    """Highest risk scores; `candidates` scores only that many of the most active countries."""
    stats = _country_stats(select_events(events, f.with_(country_code=None), places, has_country()))
    busiest = stats if candidates is None else stats.orderBy(F.desc("total_events"), "country_code").limit(candidates)
    score = risk_score(F.col("conflict_ratio"), F.col("avg_goldstein"), F.col("avg_tone"))
    scored = busiest.withColumn("score", score)
    top = cut(scored.orderBy(F.desc("score"), F.desc("total_events"), "country_code"), limit)
    return with_country_names(top, names, "country_code", "country").select(
        "country_code",
        "country_name",
        "country_display",
        "score",
        threat_band(F.col("score")).alias("band"),
        "conflict_ratio",
        "total_events",
    )


def median_score(threats: DataFrame) -> DataFrame:
    return threats.agg(F.median("score").alias("median_score"))


def weekly_deltas(
    events: DataFrame,
    countries: int = 20,
    anchor: date | None = None,
    symmetric: bool = False,
) -> DataFrame:
    """Change of the last week against the week before, for the busiest countries.

    As in the source system the current window has eight days (anchor-7 .. anchor) and
    the earlier one seven; `symmetric` compares seven with seven. One scan covers both.
    """
    oldest = -13 if symmetric else -14
    split = anchor_number(events, -6 if symmetric else -7, anchor)
    rows = events.where(days_between(events, oldest, 1, anchor)).where(has_country())
    now, before = F.col("SQLDATE") >= split, F.col("SQLDATE") < split
    windows = rows.groupBy(F.col(COUNTRY).alias("country_code")).agg(
        F.count("*").alias("both"),
        *(
            column
            for name, part in (("now", now), ("before", before))
            for column in (
                F.count_if(part).alias(f"events_{name}"),
                F.count_if(part & is_conflict()).alias(f"conflicts_{name}"),
                F.avg(F.when(part, F.col("GoldsteinScale"))).alias(f"goldstein_{name}"),
                F.coalesce(F.avg(F.when(part, F.col("AvgTone"))), F.lit(0.0)).alias(f"tone_{name}"),
            )
        ),
    )
    busiest = windows.orderBy(F.desc("both"), "country_code").limit(countries)
    for name in ("now", "before"):
        share = ratio(F.col(f"conflicts_{name}"), F.col(f"events_{name}"))
        busiest = busiest.withColumn(f"share_{name}", share).withColumn(
            f"score_{name}",
            risk_score(F.col(f"share_{name}"), F.col(f"goldstein_{name}"), F.col(f"tone_{name}")),
        )
    growth = (F.col("events_now") - F.col("events_before")).cast("double") / F.greatest(
        F.lit(1), F.col("events_before")
    )
    return busiest.select(
        "country_code",
        F.bround(growth * 100, 1).alias("event_delta_pct"),
        F.bround((F.col("share_now") - F.col("share_before")) * 100, 1).alias("conflict_delta"),
        F.bround(F.col("tone_now") - F.col("tone_before"), 1).alias("tone_delta"),
        (F.col("score_now") - F.col("score_before")).alias("score_delta"),
    )


def activity_spikes(
    events: DataFrame,
    names: DataFrame,
    min_ratio: float = 2.0,
    min_events: int = 10,
    anchor: date | None = None,
) -> DataFrame:
    """Countries whose last two days exceed the daily mean of the seven days before.

    One scan counts per country and root code; the country totals and its leading code
    follow from those few rows.
    """
    yesterday = anchor_number(events, -1, anchor)
    rows = events.where(days_between(events, -8, 1, anchor)).where(has_country())
    recent = F.col("SQLDATE") >= yesterday
    codes = rows.groupBy(F.col(COUNTRY).alias("country_code"), "EventRootCode").agg(
        F.count_if(recent).alias("recent"), F.count_if(~recent).alias("earlier")
    )
    leading = F.struct(-F.col("recent"), F.col("EventRootCode"))
    totals = codes.groupBy("country_code").agg(
        F.sum("recent").alias("events_24h"),
        (F.sum("earlier").cast("double") / 7.0).alias("baseline"),
        F.min_by("EventRootCode", leading).alias("top_cameo_root"),
    )
    times = F.col("events_24h") / F.col("baseline")
    spikes = totals.where(F.col("baseline") > 0).withColumn("times", times)
    spikes = spikes.where((F.col("times") >= min_ratio) & (F.col("events_24h") >= min_events))
    return (
        with_country_names(spikes, names, "country_code", "country")
        .select(
            "country_code",
            "country_name",
            "country_display",
            "events_24h",
            F.bround("baseline", 1).alias("baseline_avg"),
            F.bround("times", 2).alias("spike_ratio"),
            "top_cameo_root",
        )
        .orderBy(F.desc("spike_ratio"), "country_code")
    )


def alerts(spikes: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Spikes, then flagged countries that are not among them."""
    flagged = anomalies.where("is_anomaly").join(spikes, "country_code", "left_anti")
    return spikes.select(
        "country_code", F.lit("spike").alias("kind"), F.col("spike_ratio").cast("string").alias("detail")
    ).unionByName(flagged.select("country_code", F.lit("anomaly").alias("kind"), F.col("reason").alias("detail")))


def anomalous_cells(grid: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Map cells of flagged countries."""
    flagged = anomalies.where("is_anomaly").select("country_code", "reason")
    return grid.join(flagged, "country_code").select("lat", "lon", "country_code", "reason")
