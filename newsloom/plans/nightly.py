"""The nightly job: forecasts, briefings, anomalies and theme counts as cached tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from newsloom.models.anomaly import country_anomalies
from newsloom.models.forecast import FORECAST_TYPE, forecast_countries
from newsloom.operators.briefings import country_briefings
from newsloom.operators.trends import theme_category_counts
from newsloom.sources.store import read_cache, write_cache

# Name of each cached table, its file format and its columns.
CACHES = {
    "forecasts": ("parquet", FORECAST_TYPE),
    "briefings": ("json", "country_code string, briefing string, source string, summary string"),
    "anomalies": (
        "json",
        "country_code string, country_name string, country_display string, is_anomaly boolean, "
        "score double, reason string",
    ),
    "theme_categories": ("json", "category string, event_count bigint"),
}


@dataclass(frozen=True)
class NightlyOptions:
    forecast_countries: int = 50
    training_days: int = 90
    horizon_days: int = 30
    briefing_countries: int = 30
    briefing_days: int = 7
    anchor: date | None = None


def nightly_tables(
    events: DataFrame,
    names: DataFrame,
    supplied_texts: DataFrame | None = None,
    options: NightlyOptions = NightlyOptions(),
) -> dict[str, DataFrame]:
    """Each cached table as a DataFrame; every country is handled in the same few jobs."""
    o = options
    return {
        "forecasts": forecast_countries(
            events, o.forecast_countries, o.training_days, o.horizon_days, o.anchor
        ),
        "briefings": country_briefings(
            events, supplied_texts, o.briefing_days, o.briefing_countries, o.anchor
        ),
        "anomalies": country_anomalies(events, names, o.training_days, o.anchor),
        "theme_categories": theme_category_counts(events, o.briefing_days, o.anchor),
    }


def run_nightly(
    events: DataFrame,
    names: DataFrame,
    folder: str,
    supplied_texts: DataFrame | None = None,
    options: NightlyOptions = NightlyOptions(),
) -> None:
    """Compute and write all cached tables below `folder`."""
    for name, rows in nightly_tables(events, names, supplied_texts, options).items():
        write_cache(rows, f"{folder}/{name}", CACHES[name][0])


def cached(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A cached table; empty before the first run or when its shape is another one."""
    form, columns = CACHES[name]
    return read_cache(spark, f"{folder}/{name}", spark.createDataFrame([], columns).schema, form)
