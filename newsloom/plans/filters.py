"""Event filters: one immutable object compiled to DataFrame predicates."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.dates import day_number, day_number_col, number_day_col
from newsloom.schema import (
    CATEGORY_ROOT_CODES,
    PARTITION_COLUMN,
    POPULAR_MENTIONS,
    POPULAR_THEME,
    THEME_CATEGORIES,
)

DEFAULT_LOOKBACK_DAYS = 7
DEFAULT_LIMIT = 1000


@dataclass(frozen=True)
class EventFilter:
    """What to select. Every field may be left out."""

    start_date: date | None = None
    end_date: date | None = None
    country_code: str | None = None
    event_root_codes: tuple[str, ...] | None = None
    geo_country: str | None = None
    geo_state: str | None = None
    geo_city: str | None = None
    theme_category: str | None = None
    #: Rows of a list; None lists all.
    limit: int | None = DEFAULT_LIMIT

    def __post_init__(self):
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit must be at least 1, or None for all rows")

    def with_(self, **changes) -> "EventFilter":
        return replace(self, **changes)


def cut(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows, or all if there is no limit."""
    return rows if limit is None else rows.limit(limit)


def parse_root_codes(text: str | None) -> tuple[str, ...] | None:
    """'18, 19,,20' -> ('18', '19', '20'); nothing left means no filter."""
    codes = tuple(part.strip() for part in (text or "").split(",") if part.strip())
    return codes or None


def category_root_codes(category: str) -> tuple[str, ...] | None:
    return CATEGORY_ROOT_CODES.get(category.upper())


# --- days ---------------------------------------------------------------------


def _newest(events: DataFrame, offset: int) -> tuple[DataFrame, Column]:
    """What to aggregate for the newest day. The partition column needs no data pages."""
    if PARTITION_COLUMN in events.columns:
        return events.select(PARTITION_COLUMN), F.date_add(F.max(PARTITION_COLUMN), offset)
    return events.select("SQLDATE"), F.date_add(number_day_col(F.max("SQLDATE")), offset)


def anchor_day(events: DataFrame, offset: int = 0, anchor: date | None = None) -> Column:
    """Date `offset` days from the anchor, by default the newest day of the data.

    The default is a scalar subquery holding the finished value, so rows compare
    against a constant and the scan can still be pruned. Callers that know the day pass
    it and spare the subquery.
    """
    if anchor is not None:
        return F.lit(anchor + timedelta(days=offset))
    rows, day = _newest(events, offset)
    return rows.agg(day.alias("day")).scalar()


def anchor_number(events: DataFrame, offset: int = 0, anchor: date | None = None) -> Column:
    """`anchor_day` as a YYYYMMDD number."""
    if anchor is not None:
        return F.lit(day_number(anchor + timedelta(days=offset)))
    rows, day = _newest(events, offset)
    return rows.agg(day_number_col(day).alias("day")).scalar()


def days_between(
    events: DataFrame,
    first: int,
    end: int,
    anchor: date | None = None,
) -> Column:
    """Days anchor+first .. anchor+end-1, on SQLDATE and on the partition column if there."""
    condition = (F.col("SQLDATE") >= anchor_number(events, first, anchor)) & (
        F.col("SQLDATE") < anchor_number(events, end, anchor)
    )
    if PARTITION_COLUMN in events.columns:
        condition &= (F.col(PARTITION_COLUMN) >= anchor_day(events, first, anchor)) & (
            F.col(PARTITION_COLUMN) < anchor_day(events, end, anchor)
        )
    return condition


def day_range(events: DataFrame, first: date | None, last: date | None) -> Column:
    """Days first .. last, both included; an open end is not tested."""
    condition = F.lit(True)
    bounded = PARTITION_COLUMN in events.columns
    if first is not None:
        condition &= F.col("SQLDATE") >= day_number(first)
        if bounded:
            condition &= F.col(PARTITION_COLUMN) >= F.lit(first)
    if last is not None:
        after = last + timedelta(days=1)
        condition &= F.col("SQLDATE") < day_number(after)
        if bounded:
            condition &= F.col(PARTITION_COLUMN) < F.lit(after)
    return condition


def date_window(
    events: DataFrame,
    start: date | None,
    end: date | None,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
) -> Column:
    """Both ends inclusive. No end: the newest day of the data. No start: end - lookback."""
    if end is not None:
        return day_range(events, start or end - timedelta(days=lookback_days), end)
    if start is None:
        return days_between(events, -lookback_days, 1)
    newest = F.col("SQLDATE") <= anchor_number(events)
    return day_range(events, start, None) & newest


# --- row predicates -----------------------------------------------------------


def in_country(code: str) -> Column:
    """First actor or place of the action is in the country."""
    code = code.upper()
    return (F.col("Actor1CountryCode") == code) | (F.col("ActionGeo_CountryCode") == code)


def has_country() -> Column:
    return F.col("ActionGeo_CountryCode").isNotNull() & (F.col("ActionGeo_CountryCode") != "")


def in_theme_category(category: str) -> Column | None:
    """A theme of the category occurs; None (no filter) for an unknown category.

    '_' in a token matches any one character, as in LIKE.
    """
    category = category.upper()
    if category == POPULAR_THEME:
        return F.col("NumMentions") > POPULAR_MENTIONS
    tokens = THEME_CATEGORIES.get(category)
    if tokens is None:
        return None
    joined = F.array_join("themes", ";")
    return reduce(or_, (joined.ilike(f"%{token}%") for token in tokens))


def in_box(
    north: float, south: float, east: float, west: float, normalize: bool = True
) -> Column:
    """Points inside a map box; the box may cross the date line or span the world."""
    lat, lon = F.col("ActionGeo_Lat"), F.col("ActionGeo_Long")
    inside = lat.isNotNull() & lon.isNotNull() & (lat <= north) & (lat >= south)
    if not normalize:
        return inside & (lon <= east) & (lon >= west)
    if abs(east - west) >= 360:
        return inside
    east, west = ((edge + 180) % 360 - 180 for edge in (east, west))
    if west <= east:
        return inside & (lon <= east) & (lon >= west)
    return inside & ((lon <= east) | (lon >= west))


def row_predicates(f: EventFilter) -> list[Column]:
    """Everything of the filter that one row decides (no dates, no place names)."""
    conditions = []
    if f.country_code:
        conditions.append(in_country(f.country_code))
    if f.event_root_codes:
        conditions.append(F.col("EventRootCode").isin(*f.event_root_codes))
    if f.geo_country:
        conditions.append(F.col("ActionGeo_CountryCode") == f.geo_country.upper())
    if f.theme_category:
        themed = in_theme_category(f.theme_category)
        if themed is not None:
            conditions.append(themed)
    return conditions


def select_events(
    events: DataFrame,
    f: EventFilter,
    places: DataFrame | None = None,
    *extra: Column,
) -> DataFrame:
    """Rows that pass the filter. State and city need the table of places."""
    rows = events.where(date_window(events, f.start_date, f.end_date))
    for condition in (*row_predicates(f), *extra):
        rows = rows.where(condition)
    if f.geo_state or f.geo_city:
        if places is None:
            raise ValueError("a state or city filter needs a table of places")
        from newsloom.operators.geo import keep_place

        rows = keep_place(rows, places, f.geo_state, f.geo_city)
    return rows
