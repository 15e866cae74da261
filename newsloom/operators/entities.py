"""Top people, sources, themes and organizations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.functions.urls import domain
from newsloom.plans.filters import EventFilter, select_events
from newsloom.schema import LIST_COLUMNS

PEOPLE_METRICS = ("mentions", "events", "rows")


def _top(counts: DataFrame, limit: int) -> DataFrame:
    return counts.orderBy(F.desc("count"), "name").limit(limit)


def top_people(
    events: DataFrame,
    f: EventFilter,
    limit: int = 10,
    metric: str = "mentions",
    places: DataFrame | None = None,
) -> DataFrame:
    """People by summed mentions, by distinct events or by rows that name them."""
    measure: dict[str, Column] = {
        "mentions": F.coalesce(F.sum("NumMentions"), F.lit(0)),
        "events": F.count_distinct("GLOBALEVENTID"),
        "rows": F.count("*"),
    }
    rows = select_events(events, f, places, F.size("persons") > 0)
    people = rows.select("GLOBALEVENTID", "NumMentions", F.explode("persons").alias("name"))
    named = people.where(F.col("name") != "")
    return _top(named.groupBy("name").agg(measure[metric].alias("count")), limit)


def top_sources(
    events: DataFrame, f: EventFilter, limit: int = 10, places: DataFrame | None = None
) -> DataFrame:
    """Web domains by number of events."""
    rows = select_events(events, f, places, F.col("SOURCEURL") != "")
    names = rows.select(domain(F.col("SOURCEURL")).alias("name")).where(F.col("name") != "")
    return _top(names.groupBy("name").agg(F.count("*").alias("count")), limit)


def _tagged(kind: str) -> Column:
    names = F.coalesce(F.col(kind), F.array().cast("array<string>"))
    return F.transform(names, lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name")))


def region_entities(
    events: DataFrame,
    country_code: str,
    f: EventFilter,
    limit: int = 10,
    newest: int | None = None,
    places: DataFrame | None = None,
) -> DataFrame:
    """Top themes, persons and organizations of a country.

    One pass over the rows: the three lists are exploded together and counted. With
    `newest` only that many of the latest events are looked at.
    """
    rows = select_events(events, f.with_(country_code=country_code), places)
    if newest is not None:
        rows = rows.orderBy(F.desc("SQLDATE"), F.desc("GLOBALEVENTID")).limit(newest)
    tagged = F.concat(*(_tagged(kind) for kind in LIST_COLUMNS))
    entries = rows.select(F.inline(tagged))
    counts = entries.groupBy("kind", "name").agg(F.count("*").alias("count"))
    order = Window.partitionBy("kind").orderBy(F.desc("count"), "name")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit).select("kind", "rank", "name", "count")
