"""Ingestion queries over feeds derived from the test tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from newsloom.functions.text import entity_list
from newsloom.plans import enrichment
from newsloom.sources import demo_feeds, landed, lookups, store
from newsloom.sources.demo_events import (
    ORGANIZATIONS,
    PERSONS,
    THEMES,
    country_names,
    enriched_events,
    table,
)
from workload.base import NAMES_VIEW, display, on_events, pick, r6, register


@register(
    "manifest_urls",
    """SELECT kind, max_by(url, page_id) AS url FROM (SELECT page_id,
      (['events', 'mentions', 'entities', NULL])[(page_id % 4 + 1)::INT] AS kind, 'http://feed.example/' || page_id ||
      (['.export.CSV.zip', '.mentions.CSV.zip', '.gkg.csv.zip', '.txt'])[(page_id % 4 + 1)::INT] AS url FROM pages)
    WHERE kind IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    return landed.manifest_urls(demo_feeds.manifest_lines(spark, sf), "line")


_RAW = f"""GLOBALEVENTID, SQLDATE::BIGINT AS SQLDATE, MonthYear::BIGINT AS MonthYear, "Year"::BIGINT AS "Year",
  Actor1CountryCode, Actor2CountryCode, Actor1Type1Code, Actor2Type1Code, EventCode, EventBaseCode, EventRootCode,
  QuadClass::BIGINT AS QuadClass, {r6('GoldsteinScale')} AS GoldsteinScale, NumMentions, NumSources,
  {r6('AvgTone')} AS AvgTone, Actor1Geo_CountryCode, Actor2Geo_CountryCode, ActionGeo_CountryCode,
  {r6('ActionGeo_Lat')} AS ActionGeo_Lat, {r6('ActionGeo_Long')} AS ActionGeo_Long, SOURCEURL"""
_FED = "SELECT * REPLACE (CASE WHEN GLOBALEVENTID % 17 <> 0 THEN GoldsteinScale END AS GoldsteinScale) FROM ev"


@register(
    "landed_events",
    on_events(
        f"""SELECT {_RAW}, '' AS themes, '' AS persons, '' AS organizations, NULL::BIGINT AS mentions_count,
        NULL::DOUBLE AS avg_confidence FROM fed""",
        f"fed AS ({_FED})",
    ),
)
def _(spark, sf):
    return landed.conform(landed.landed_events(demo_feeds.event_lines(spark, sf)))


_ITEMS = """list_filter(list_transform(string_split(translate(text, '. ', ';,'), ';'),
  lambda x: trim(x, E' \\t\\n\\r\\f\\x0b')), lambda x: x <> '')"""


@register(
    "entity_lists",
    f"""SELECT doc_id, array_to_string(list_transform({_ITEMS}, lambda x: split_part(x, ',', 1)), '|') AS items,
    array_to_string(list_sort(list_distinct(list_transform({_ITEMS}, lambda x: split_part(x, ',', 1)))), '|')
      AS distinct_items FROM documents""",
)
def _(spark, sf):
    text = F.translate("text", ". ", ";,")
    return table(spark, sf, "documents").select(
        "doc_id", entity_list(text).alias("items"), entity_list(text, distinct=True).alias("distinct_items")
    )


_MENTIONS = """mentions AS (SELECT l_orderkey AS id, url, l_linenumber::BIGINT * 1000000 + l_partkey AS arrival,
    CASE WHEN l_partkey % 19 <> 0 THEN (l_quantity * 2)::INT::DOUBLE END AS confidence
    FROM lineitem LEFT JOIN pages ON l_partkey % (SELECT max(page_id) + 1 FROM pages) = page_id),
  mention_stats AS (SELECT id, count(*) AS mentions, avg(confidence) AS conf,
    arg_min(url, arrival) AS first_url FROM mentions GROUP BY 1)"""


@register(
    "mention_stats",
    f"""WITH {_MENTIONS} SELECT id AS GLOBALEVENTID, mentions AS mentions_count, {r6('conf')} AS avg_confidence
    FROM mention_stats""",
)
def _(spark, sf):
    return enrichment.mention_stats(demo_feeds.mentions(spark, sf))


@register(
    "first_mentions",
    f"""WITH {_MENTIONS} SELECT m.id AS GLOBALEVENTID, mentions AS mentions_count, {r6('conf')} AS avg_confidence,
    first_url AS top_mention_url FROM mention_stats m""",
)
def _(spark, sf):
    return enrichment.first_mentions(demo_feeds.mentions(spark, sf), F.col("arrival"))


def _listed(values, step):
    first, second = pick(values, "page_id"), pick(values, f"page_id * {step} + 1")
    return f"[{first}, {second}, {first}]"


_DOCUMENTS = f"""docs AS (SELECT url, CASE WHEN page_id % 10 <> 0 THEN {_listed(THEMES, 3)} END AS t,
    {_listed(PERSONS, 5)} AS p, {_listed(ORGANIZATIONS, 2)} AS o FROM pages
    UNION ALL SELECT url, CASE WHEN page_id % 8 <> 0 THEN {_listed(THEMES, 7)} END,
    {_listed(PERSONS, 3)}, {_listed(ORGANIZATIONS, 4)} FROM pages WHERE page_id % 4 = 0),
  fullest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url
    ORDER BY t IS NULL, t[1] || ',12; ' || t[2] || ',80;' || t[3],
      p[1] || ',12; ' || p[2], o[1] || ',12; ' || o[2]) AS nth FROM docs) WHERE nth = 1),
  every_list AS (SELECT url, flatten(list(t) FILTER (t IS NOT NULL)) AS t, flatten(list(p)) AS p, flatten(list(o)) AS o
    FROM docs GROUP BY url)"""


def _enriched_sql(distinct, url):
    def lists(column, name):
        value = f"list_sort(list_distinct({column}))" if distinct else column
        return f"coalesce(array_to_string({value}, '|'), '') AS {name}"

    stats = "coalesce(mentions, 0)" if distinct else "mentions"
    one_doc = "every_list" if distinct else "fullest"
    return on_events(
        f"""SELECT {_RAW}, {lists('t', 'themes')}, {lists('p', 'persons')}, {lists('o', 'organizations')},
        {stats} AS mentions_count, {r6('conf')} AS avg_confidence
        FROM ev LEFT JOIN mention_stats ON id = GLOBALEVENTID LEFT JOIN {one_doc} AS one_doc ON one_doc.url = {url}""",
        _MENTIONS,
        _DOCUMENTS,
    )


def _raw_events(spark, sf):
    return enriched_events(spark, sf, urls=True).select(*landed.EVENT_POSITIONS)


@register("enrich_batch", _enriched_sql(True, "SOURCEURL"))
def _(spark, sf):
    return enrichment.enrich_batch(
        _raw_events(spark, sf), demo_feeds.mentions(spark, sf), demo_feeds.documents(spark, sf)
    )


@register("enrich_stream", _enriched_sql(False, "first_url"))
def _(spark, sf):
    return enrichment.enrich_stream(
        _raw_events(spark, sf),
        demo_feeds.mentions(spark, sf),
        demo_feeds.documents(spark, sf),
        F.col("arrival"),
    )


@register("one_day", on_events(f"SELECT {_RAW} FROM ev WHERE SQLDATE = 20240110"))
def _(spark, sf):
    return store.one_day(enriched_events(spark, sf, urls=True), date(2024, 1, 10))


@register(
    "newest_ids",
    on_events("SELECT GLOBALEVENTID FROM ev"),
)
def _(spark, sf):
    return enrichment.newest_ids(enriched_events(spark, sf))


@register(
    "drop_known",
    on_events(
        """SELECT GLOBALEVENTID, SQLDATE::BIGINT AS SQLDATE FROM ev WHERE GLOBALEVENTID NOT IN
        (SELECT GLOBALEVENTID FROM ev WHERE GLOBALEVENTID % 3 = 1)"""
    ),
)
def _(spark, sf):
    events = enriched_events(spark, sf)
    known = enrichment.newest_ids(events.where("GLOBALEVENTID % 3 = 1"))
    return enrichment.drop_known(events, known).select("GLOBALEVENTID", "SQLDATE")


@register(
    "keep_last",
    """SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber FROM (SELECT *, row_number() OVER
    (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS nth FROM lineitem)
    WHERE nth = 1""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    order = (F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))
    return enrichment.keep_last(lines, *order, key="l_orderkey").drop("l_suppkey")


@register(
    "with_buffer",
    on_events("SELECT SQLDATE::BIGINT AS SQLDATE, count(*) AS n FROM ev GROUP BY 1"),
)
def _(spark, sf):
    events = enriched_events(spark, sf)
    stored, buffer = events.where("SQLDATE < 20240120"), events.where("SQLDATE >= 20240118")
    return store.with_buffer(stored, buffer).groupBy("SQLDATE").agg(F.count("*").alias("n"))


_LOOKUP = """SELECT upper(n_name) AS code, 'Land ' || n_nationkey AS name FROM nation
  WHERE n_nationkey NOT IN (0, 1) AND n_nationkey % 9 <> 2"""


@register("lookup_lines", _LOOKUP)
def _(spark, sf):
    return lookups.parse_lookup(demo_feeds.lookup_lines(spark, sf))


@register("preferred_lookup", _LOOKUP)
def _(spark, sf):
    first = lookups.parse_lookup(demo_feeds.lookup_lines(spark, sf).where(F.col("value") == ""))
    second = lookups.parse_lookup(demo_feeds.lookup_lines(spark, sf))
    return lookups.prefer(first, second, country_names(spark, sf))


@register(
    "country_display",
    on_events(
        f"""SELECT GLOBALEVENTID, ActionGeo_CountryCode AS code, name AS country_name,
        {display('ActionGeo_CountryCode', 'name')} AS country_display FROM (SELECT GLOBALEVENTID,
          CASE WHEN GLOBALEVENTID % 50 <> 0 THEN ActionGeo_CountryCode END AS ActionGeo_CountryCode FROM ev)
        LEFT JOIN names ON names.code = ActionGeo_CountryCode""",
        NAMES_VIEW,
    ),
)
def _(spark, sf):
    code = F.when(F.col("GLOBALEVENTID") % 50 != 0, F.col("ActionGeo_CountryCode"))
    events = enriched_events(spark, sf).select("GLOBALEVENTID", code.alias("code"))
    return lookups.with_country_names(events, country_names(spark, sf), "code", "country")
