"""Row queries: event lists, single events, map details."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.dates import number_day_col
from newsloom.plans.filters import POPULAR_MENTIONS, EventFilter, cut, in_box, select_events


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>")).alias(name)


def _count(name: str, alias: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(alias)


def event_columns() -> list[Column]:
    """The 19 fields of an event row."""
    return [
        F.col("GLOBALEVENTID").alias("global_event_id"),
        number_day_col(F.col("SQLDATE")).alias("sql_date"),
        F.col("Actor1CountryCode").alias("actor1_country_code"),
        F.col("Actor2CountryCode").alias("actor2_country_code"),
        F.col("EventRootCode").alias("event_root_code"),
        F.col("EventCode").alias("event_code"),
        F.col("GoldsteinScale").alias("goldstein_scale"),
        _count("NumMentions", "num_mentions"),
        _count("NumSources", "num_sources"),
        F.col("AvgTone").alias("avg_tone"),
        _list("themes"),
        _list("persons"),
        _list("organizations"),
        _count("mentions_count", "mentions_count"),
        F.col("avg_confidence"),
        F.col("ActionGeo_CountryCode").alias("action_geo_country_code"),
        F.col("ActionGeo_Lat").alias("action_geo_lat"),
        F.col("ActionGeo_Long").alias("action_geo_long"),
        F.col("SOURCEURL").alias("source_url"),
    ]


def map_detail_columns() -> list[Column]:
    """The 23 fields of a map detail row."""
    return [
        F.col("GLOBALEVENTID").alias("global_event_id"),
        number_day_col(F.col("SQLDATE")).alias("sql_date"),
        F.col("ActionGeo_Lat").alias("lat"),
        F.col("ActionGeo_Long").alias("lon"),
        F.col("Actor1CountryCode").alias("actor1_country_code"),
        F.col("Actor2CountryCode").alias("actor2_country_code"),
        F.col("EventRootCode").alias("event_root_code"),
        F.col("QuadClass").alias("quad_class"),
        F.col("Actor1Type1Code").alias("actor1_type_code"),
        F.col("Actor2Type1Code").alias("actor2_type_code"),
        F.col("EventCode").alias("event_code"),
        F.col("Actor1Geo_CountryCode").alias("actor1_geo_country_code"),
        F.col("Actor2Geo_CountryCode").alias("actor2_geo_country_code"),
        F.col("GoldsteinScale").alias("goldstein_scale"),
        _count("NumMentions", "num_mentions"),
        _count("NumSources", "num_sources"),
        F.col("AvgTone").alias("avg_tone"),
        F.col("SOURCEURL").alias("source_url"),
        F.col("Actor1Type1Code").alias("actor1_type"),
        F.col("Actor2Type1Code").alias("actor2_type"),
        _list("themes"),
        _list("persons"),
        _list("organizations"),
    ]


def list_events(events: DataFrame, f: EventFilter, places: DataFrame | None = None) -> DataFrame:
    """Newest events first, ties by id, up to the limit of the filter."""
    rows = select_events(events, f, places)
    newest = cut(rows.orderBy(F.desc("SQLDATE"), F.desc("GLOBALEVENTID")), f.limit)
    return newest.select(event_columns())


def list_region_events(
    events: DataFrame, country_code: str, f: EventFilter, places: DataFrame | None = None
) -> DataFrame:
    return list_events(events, f.with_(country_code=country_code.upper()), places)


def event_by_id(events: DataFrame, event_id: int) -> DataFrame:
    """At most one row."""
    return events.where(F.col("GLOBALEVENTID") == event_id).limit(1).select(event_columns())


def popular_events(
    events: DataFrame, f: EventFilter, above: int = POPULAR_MENTIONS, limit: int | None = None,
    places: DataFrame | None = None,
) -> DataFrame:
    """All selected events with more than `above` mentions, most mentioned first; `limit` cuts after the sort."""
    rows = select_events(events, f, places, F.col("NumMentions") > above)
    order = (F.desc("NumMentions"), F.desc("SQLDATE"), F.desc("GLOBALEVENTID"))
    return cut(rows.orderBy(*order), limit).select(event_columns())


def map_details(
    events: DataFrame,
    box: dict[str, float],
    f: EventFilter,
    min_mentions: int = 1,
    places: DataFrame | None = None,
    normalize: bool = True,
) -> DataFrame:
    """Single events in a map box (keys north, south, east, west), most mentioned first."""
    inside = in_box(**box, normalize=normalize) & (F.col("NumMentions") >= min_mentions)
    rows = select_events(events, f.with_(country_code=None), places, inside)
    top = cut(rows.orderBy(F.desc("NumMentions"), "GLOBALEVENTID"), f.limit)
    return top.select(map_detail_columns())


# --- zoom rules of the map ----------------------------------------------------


def grid_digits(zoom: float) -> int | None:
    """Decimal places of the map grid, None where single events are shown."""
    if zoom >= 9:
        return None
    return next((digits for low, digits in ((7, 4), (5, 3), (3, 2), (1, 1)) if zoom >= low), 0)


def detail_limit(zoom: float, limit: int | None) -> int:
    return min(math.inf if limit is None else limit, max(500, int(3000 / (1 + (zoom - 9) * 0.4))))


def detail_min_mentions(zoom: float) -> int:
    return max(1, int(8 - zoom))


def snap_box(box: dict[str, float], zoom: float) -> dict[str, float]:
    """Widen a box to a grid of the zoom level, so that near boxes ask the same query."""
    step = next((s for high, s in ((4, 5), (8, 1), (11, 0.2)) if zoom < high), 0.05)
    outward = {"north": math.ceil, "south": math.floor, "east": math.ceil, "west": math.floor}
    return {side: outward[side](edge / step) * step for side, edge in box.items()}
