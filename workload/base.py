"""What the registered queries share: flat results and the event view in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsloom.schema import ACTOR_TYPE_LABELS
from newsloom.sources.demo_events import ORGANIZATIONS, PERSONS, QUAD_CLASS_OF_TYPE, THEMES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def flat(rows: DataFrame) -> DataFrame:
    """Types both engines print alike: big integers, rounded doubles, text for the rest."""

    def plain(field: T.StructField):
        value, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.IntegralType):
            value = value.cast("bigint")
        elif isinstance(kind, T.FractionalType):
            # The nudge takes exact halves, frequent in means of 64 or 128 rows, one way.
            value = F.round(value.cast("double") + 1e-9, 6) + F.lit(0.0)
        elif isinstance(kind, T.ArrayType):
            value = F.array_join(value, "|")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        return value.alias(field.name)

    return rows.select([plain(field) for field in rows.schema])


def register(name: str, sql: str | None = None):
    """Registers a query; its result is flattened. `sql` is the same query for the oracle."""

    def add(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: flat(build(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


# --- the event view in SQL --------------------------------------------------------


def names(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values, index: str) -> str:
    return f"({names(values)})[(({index}) % {len(values)} + 1)::INT]"


def _two(values, spread: int) -> str:
    return (
        f"CASE WHEN event_id % 6 = 0 THEN CAST([] AS VARCHAR[]) ELSE "
        f"[{pick(values, 'event_id')}, {pick(values, f'event_id // {spread}')}] END"
    )


_TYPES = sorted(ACTOR_TYPE_LABELS)
_QUAD = " ".join(f"WHEN '{kind}' THEN {quad}" for kind, quad in QUAD_CLASS_OF_TYPE.items())

EVENT_VIEW = f"""
ev AS (
  SELECT event_id AS GLOBALEVENTID,
    (year(ts)*10000 + month(ts)*100 + day(ts))::INT AS SQLDATE,
    CAST(ts AS DATE) AS d, ts,
    (year(ts)*100 + month(ts))::INT AS MonthYear, year(ts)::INT AS "Year",
    'N' || (event_id % 25) AS Actor1CountryCode,
    CASE WHEN event_id % 11 <> 0 THEN 'N' || (event_id % 23) END AS Actor2CountryCode,
    {pick(_TYPES, 'event_id')} AS Actor1Type1Code,
    CASE WHEN event_id % 5 <> 0 THEN {pick(_TYPES, 'event_id // 3')} END AS Actor2Type1Code,
    lpad((event_id % 20 + 1)::VARCHAR, 2, '0') || '0' AS EventCode,
    lpad((event_id % 20 + 1)::VARCHAR, 2, '0') AS EventBaseCode,
    lpad((event_id % 20 + 1)::VARCHAR, 2, '0') AS EventRootCode,
    CASE event_type {_QUAD} END AS QuadClass,
    CAST(event_id * 7919 % 201 AS DOUBLE) / 10 - 10 AS GoldsteinScale,
    TRY_CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS NumMentions,
    event_id % 9 + 1 AS NumSources,
    greatest(CAST(-30 AS DOUBLE), 10 - value / 5) AS AvgTone,
    'N' || (event_id % 25) AS Actor1Geo_CountryCode,
    CASE WHEN event_id % 11 <> 0 THEN 'N' || (event_id % 23) END AS Actor2Geo_CountryCode,
    n_name AS ActionGeo_CountryCode,
    ((user_id % 25) * 7 % 160 - 80) + CAST(event_id % 10 AS DOUBLE) / 10 AS ActionGeo_Lat,
    ((user_id % 25) * 29 % 340 - 170) + CAST(event_id % 7 AS DOUBLE) / 10 AS ActionGeo_Long,
    url AS SOURCEURL,
    {_two(THEMES, 13)} AS themes,
    {_two(PERSONS, 11)} AS persons,
    {_two(ORGANIZATIONS, 7)} AS organizations,
    event_id % 13 AS mentions_count,
    CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 10 AS DOUBLE) * 10 END AS avg_confidence
  FROM events
  LEFT JOIN nation ON user_id % 25 = n_nationkey
  LEFT JOIN pages ON event_id % (SELECT max(page_id) + 1 FROM pages) = page_id
)"""

NAMES_VIEW = """
names AS (
  SELECT n_name AS code, r_name || ' ' || n_nationkey AS name
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20
)"""


def on_events(sql: str, *views: str) -> str:
    """`sql` with the event view `ev` and further views in front."""
    return f"WITH {', '.join((EVENT_VIEW, *views))}\n{sql}"


def r6(expression: str) -> str:
    return f"round({expression} + 1e-9::DOUBLE, 6) + 0.0"


def joined(expression: str) -> str:
    return f"array_to_string({expression}, '|')"


ANCHOR = "(SELECT max(d) FROM ev)"


def since(days: int) -> str:
    return f"d >= {ANCHOR} - {days} AND d <= {ANCHOR}"


CONFLICT = "count(*) FILTER (QuadClass IN (3, 4))"
SHARE = f"CAST({CONFLICT} AS DOUBLE) / count(*)"


def score(share: str, goldstein: str, tone: str) -> str:
    """Risk score in SQL."""
    g = f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, (-coalesce({goldstein}, 0.0::DOUBLE) + 10) / 20 * 100))"
    t = f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, (-coalesce({tone}, 0.0::DOUBLE) + 30) / 60 * 100))"
    return (
        f"CAST(round_even(coalesce({share}, 0.0::DOUBLE) * 100 * 0.4::DOUBLE + {g} * 0.35::DOUBLE "
        f"+ {t} * 0.25::DOUBLE, 0) AS BIGINT)"
    )


def display(code: str, name: str) -> str:
    return (
        f"CASE WHEN coalesce({code}, '') = '' THEN 'Unknown' WHEN {name} IS NULL THEN {code} "
        f"ELSE {name} || ' (' || {code} || ')' END"
    )


EVENT_FIELDS = f"""
  GLOBALEVENTID AS global_event_id, strftime(d, '%Y-%m-%d') AS sql_date,
  Actor1CountryCode AS actor1_country_code, Actor2CountryCode AS actor2_country_code,
  EventRootCode AS event_root_code, EventCode AS event_code, {r6('GoldsteinScale')} AS goldstein_scale,
  coalesce(NumMentions, 0) AS num_mentions, coalesce(NumSources, 0) AS num_sources,
  {r6('AvgTone')} AS avg_tone, {joined('themes')} AS themes, {joined('persons')} AS persons,
  {joined('organizations')} AS organizations, mentions_count, {r6('avg_confidence')} AS avg_confidence,
  ActionGeo_CountryCode AS action_geo_country_code, {r6('ActionGeo_Lat')} AS action_geo_lat,
  {r6('ActionGeo_Long')} AS action_geo_long, SOURCEURL AS source_url"""
