"""Event lists, trends, people, risk and tiers over the event view."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from newsloom.functions.dates import clamp_window_cols, number_day_col
from newsloom.operators import briefings, entities, geo, quality, risk, rows, trends
from newsloom.plans import tiers
from newsloom.plans.filters import (
    EventFilter,
    category_root_codes,
    days_between,
    has_country,
    in_box,
    in_country,
    in_theme_category,
    parse_root_codes,
)
from newsloom.schema import CATEGORY_ROOT_CODES, POPULAR_THEME, THEME_CATEGORIES
from newsloom.session import work_dir
from newsloom.sources.demo_events import country_names, enriched_events, places, table
from newsloom.sources.demo_feeds import briefing_texts
from workload.base import (
    ANCHOR,
    CONFLICT,
    EVENT_FIELDS,
    NAMES_VIEW,
    ORACLE,
    SHARE,
    display,
    joined,
    on_events,
    r6,
    register,
    score,
    since,
)

WORLD = {"north": 90.0, "south": -90.0, "east": 180.0, "west": -180.0}
PACIFIC = {"north": 60.0, "south": -60.0, "east": 210.0, "west": 120.0}
JANUARY = EventFilter(start_date=date(2024, 1, 5), end_date=date(2024, 1, 25), limit=None)
IN_JANUARY = "SQLDATE >= 20240105 AND SQLDATE < 20240126"


# --- rows -------------------------------------------------------------------------


@register(
    "enriched_events",
    on_events(
        f"""SELECT GLOBALEVENTID, SQLDATE::BIGINT AS SQLDATE, MonthYear::BIGINT AS MonthYear,
        "Year"::BIGINT AS "Year", Actor1CountryCode, Actor2CountryCode, Actor1Type1Code, Actor2Type1Code,
        EventCode, EventBaseCode, EventRootCode, QuadClass::BIGINT AS QuadClass,
        {r6('GoldsteinScale')} AS GoldsteinScale, NumMentions, NumSources, {r6('AvgTone')} AS AvgTone,
        Actor1Geo_CountryCode, Actor2Geo_CountryCode, ActionGeo_CountryCode,
        {r6('ActionGeo_Lat')} AS ActionGeo_Lat, {r6('ActionGeo_Long')} AS ActionGeo_Long, SOURCEURL,
        {joined('themes')} AS themes, {joined('persons')} AS persons, {joined('organizations')} AS organizations,
        mentions_count, {r6('avg_confidence')} AS avg_confidence, strftime(d, '%Y-%m-%d') AS event_date FROM ev"""
    ),
)
def _(spark, sf):
    return enriched_events(spark, sf, urls=True)


@register(
    "event_list",
    on_events(
        f"SELECT {EVENT_FIELDS} FROM ev WHERE {since(7)} ORDER BY SQLDATE DESC, GLOBALEVENTID DESC LIMIT 1000"
    ),
)
def _(spark, sf):
    return rows.list_events(enriched_events(spark, sf, urls=True), EventFilter())


@register(
    "event_list_filtered",
    on_events(
        f"""SELECT {EVENT_FIELDS} FROM ev WHERE {IN_JANUARY}
        AND (Actor1CountryCode = 'N7' OR ActionGeo_CountryCode = 'N7') AND EventRootCode IN ('03', '08', '18')
        AND (array_to_string(themes, ';') ILIKE '%ECON_%' OR array_to_string(themes, ';') ILIKE '%TRADE%'
          OR array_to_string(themes, ';') ILIKE '%MARKET%' OR array_to_string(themes, ';') ILIKE '%SANCTIONS%'
          OR array_to_string(themes, ';') ILIKE '%WB_ECONOMY%')"""
    ),
)
def _(spark, sf):
    f = JANUARY.with_(
        country_code="n7", event_root_codes=parse_root_codes("03, 08,,18"), theme_category="economy"
    )
    return rows.list_events(enriched_events(spark, sf, urls=True), f)


@register(
    "region_events",
    on_events(
        f"""SELECT {EVENT_FIELDS} FROM ev
        WHERE {since(7)} AND (Actor1CountryCode = 'NATION_7' OR ActionGeo_CountryCode = 'NATION_7')
        ORDER BY SQLDATE DESC, GLOBALEVENTID DESC LIMIT 1000"""
    ),
)
def _(spark, sf):
    return rows.list_region_events(enriched_events(spark, sf, urls=True), "nation_7", EventFilter())


@register("event_by_id", on_events(f"SELECT {EVENT_FIELDS} FROM ev WHERE GLOBALEVENTID = 77"))
def _(spark, sf):
    return rows.event_by_id(enriched_events(spark, sf, urls=True), 77)


@register(
    "popular_events",
    on_events(
        f"SELECT {EVENT_FIELDS} FROM ev WHERE {since(7)} AND NumMentions > 10"
    ),
)
def _(spark, sf):
    return rows.popular_events(enriched_events(spark, sf, urls=True), EventFilter())


_DETAILS = f"""
  GLOBALEVENTID AS global_event_id, strftime(d, '%Y-%m-%d') AS sql_date, {r6('ActionGeo_Lat')} AS lat,
  {r6('ActionGeo_Long')} AS lon, Actor1CountryCode AS actor1_country_code,
  Actor2CountryCode AS actor2_country_code, EventRootCode AS event_root_code,
  QuadClass::BIGINT AS quad_class, Actor1Type1Code AS actor1_type_code,
  Actor2Type1Code AS actor2_type_code, EventCode AS event_code,
  Actor1Geo_CountryCode AS actor1_geo_country_code, Actor2Geo_CountryCode AS actor2_geo_country_code,
  {r6('GoldsteinScale')} AS goldstein_scale, NumMentions AS num_mentions, NumSources AS num_sources,
  {r6('AvgTone')} AS avg_tone, SOURCEURL AS source_url, Actor1Type1Code AS actor1_type,
  Actor2Type1Code AS actor2_type, {joined('themes')} AS themes, {joined('persons')} AS persons,
  {joined('organizations')} AS organizations"""


@register(
    "map_details",
    on_events(
        f"""SELECT {_DETAILS} FROM ev WHERE {IN_JANUARY} AND ActionGeo_Lat BETWEEN -40 AND 40
        AND ActionGeo_Long BETWEEN -60 AND 60 AND NumMentions >= 3
        ORDER BY NumMentions DESC, GLOBALEVENTID LIMIT 500"""
    ),
)
def _(spark, sf):
    box = {"north": 40.0, "south": -40.0, "east": 60.0, "west": -60.0}
    limit = rows.detail_limit(30, 10_000)
    return rows.map_details(enriched_events(spark, sf, urls=True), box, JANUARY.with_(limit=limit), 3)


@register(
    "map_details_date_line",
    on_events(
        f"""SELECT {_DETAILS} FROM ev WHERE {IN_JANUARY} AND ActionGeo_Lat BETWEEN -60 AND 60
        AND (ActionGeo_Long <= -150 OR ActionGeo_Long >= 120) AND NumMentions >= 1
        ORDER BY NumMentions DESC, GLOBALEVENTID LIMIT 3000"""
    ),
)
def _(spark, sf):
    f = JANUARY.with_(limit=rows.detail_limit(9, 10_000))
    return rows.map_details(enriched_events(spark, sf, urls=True), PACIFIC, f, rows.detail_min_mentions(9))


# --- filters ------------------------------------------------------------------------

_LIKES = {
    category: " OR ".join(f"array_to_string(themes, ';') ILIKE '%{token}%'" for token in tokens)
    for category, tokens in THEME_CATEGORIES.items()
}


@register(
    "theme_filter_counts",
    on_events(
        "SELECT "
        + ", ".join(f"count(*) FILTER ({test}) AS {c.lower()}" for c, test in _LIKES.items())
        + ", count(*) FILTER (NumMentions > 10) AS popular_news FROM ev"
    ),
)
def _(spark, sf):
    wanted = (*THEME_CATEGORIES, POPULAR_THEME)
    return enriched_events(spark, sf).agg(
        *(F.count_if(in_theme_category(c)).alias(c.lower()) for c in wanted)
    )


@register(
    "filter_counts",
    on_events(
        """SELECT count(*) FILTER (Actor1CountryCode = 'NATION_4' OR ActionGeo_CountryCode = 'NATION_4') AS country,
        count(*) FILTER (ActionGeo_Lat BETWEEN -10.5 AND 35 AND ActionGeo_Long BETWEEN -100 AND 20.25) AS box,
        count(*) FILTER (ActionGeo_Lat BETWEEN -60 AND 60
          AND (ActionGeo_Long <= -150 OR ActionGeo_Long >= 120)) AS box_over_date_line,
        count(*) FILTER (ActionGeo_Lat BETWEEN -60 AND 60 AND ActionGeo_Long BETWEEN 120 AND 210) AS box_as_given,
        count(*) FILTER (ActionGeo_Lat BETWEEN -90 AND 90) AS world,
        count(*) FILTER (ActionGeo_CountryCode <> '') AS with_country,
        count(*) FILTER (len(persons) > 0) AS with_people,
        count(*) FILTER (NumMentions >= 5) AS mentioned FROM ev"""
    ),
)
def _(spark, sf):
    box = {"north": 35.0, "south": -10.5, "east": 20.25, "west": -100.0}
    return enriched_events(spark, sf).agg(
        F.count_if(in_country("nation_4")).alias("country"),
        F.count_if(in_box(**box)).alias("box"),
        F.count_if(in_box(**PACIFIC)).alias("box_over_date_line"),
        F.count_if(in_box(**PACIFIC, normalize=False)).alias("box_as_given"),
        F.count_if(in_box(**WORLD)).alias("world"),
        F.count_if(has_country()).alias("with_country"),
        F.count_if(F.size("persons") > 0).alias("with_people"),
        F.count_if(F.col("NumMentions") >= 5).alias("mentioned"),
    )


@register(
    "category_counts",
    on_events(
        "SELECT "
        + ", ".join(
            "count(*) AS all_events" if codes is None
            else f"count(*) FILTER (EventRootCode IN {codes}) AS {name.lower()}"
            for name, codes in CATEGORY_ROOT_CODES.items()
        )
        + " FROM ev"
    ),
)
def _(spark, sf):
    def counted(name):
        codes = category_root_codes(name)
        if codes is None:
            return F.count("*").alias("all_events")
        return F.count_if(F.col("EventRootCode").isin(*codes)).alias(name.lower())

    return enriched_events(spark, sf).agg(*(counted(name) for name in CATEGORY_ROOT_CODES))


@register(
    "available_window",
    on_events(
        """, w AS (SELECT max(d) AS hi, max(d) - (count(DISTINCT d)::INT - 1) AS lo FROM ev)
        SELECT strftime(least(least(greatest(DATE '2023-12-01', lo), hi), least(greatest(DATE '2024-01-20', lo), hi)),
          '%Y-%m-%d') AS first_day,
        strftime(greatest(least(greatest(DATE '2023-12-01', lo), hi), least(greatest(DATE '2024-01-20', lo), hi)),
          '%Y-%m-%d') AS last_day FROM w"""
    ).replace(")\n, w", "),\n w").replace("\n, w AS", ", w AS"),
)
def _(spark, sf):
    days = enriched_events(spark, sf).groupBy("SQLDATE").count()
    covered = days.agg(
        number_day_col(F.max("SQLDATE")).alias("newest"), F.count("*").cast("int").alias("days")
    )
    first, last = clamp_window_cols(
        F.col("newest"), F.col("days"), F.lit(date(2024, 1, 20)), F.lit(date(2023, 12, 1))
    )
    return covered.select(first.alias("first_day"), last.alias("last_day"))


# --- trends -------------------------------------------------------------------------

_DAILY = f"""strftime(d, '%Y-%m-%d') AS date, count(*) AS count, {r6('avg(GoldsteinScale)')} AS avg_goldstein_scale,
  coalesce(sum(NumMentions), 0)::BIGINT AS total_mentions, {r6('avg(AvgTone)')} AS avg_tone"""


@register("daily_counts", on_events(f"SELECT {_DAILY} FROM ev WHERE {IN_JANUARY} GROUP BY d"))
def _(spark, sf):
    return trends.daily_counts(enriched_events(spark, sf), JANUARY)


@register(
    "daily_counts_country",
    on_events(
        f"""SELECT {_DAILY} FROM ev WHERE {since(30)}
        AND (Actor1CountryCode = 'N3' OR ActionGeo_CountryCode = 'N3') GROUP BY d"""
    ),
)
def _(spark, sf):
    events = enriched_events(spark, sf)
    return trends.daily_counts(events.where(days_between(events, -30, 1)), EventFilter(
        start_date=date(2023, 1, 1), country_code="N3"))


@register(
    "daily_trend",
    on_events(
        f"""SELECT strftime(d, '%Y-%m-%d') AS date, count(*) AS total, count(*) FILTER (QuadClass >= 3) AS conflict
        FROM ev WHERE {IN_JANUARY} AND EventRootCode IN ('18', '19', '20') GROUP BY d"""
    ),
)
def _(spark, sf):
    f = JANUARY.with_(event_root_codes=category_root_codes("CONFLICT"))
    return trends.daily_trend(enriched_events(spark, sf), f)


@register(
    "last_fourteen_days",
    on_events(
        f"""SELECT * FROM (SELECT {_DAILY} FROM ev WHERE {IN_JANUARY}
        AND (Actor1CountryCode = 'N3' OR ActionGeo_CountryCode = 'N3') GROUP BY d) ORDER BY date DESC LIMIT 14"""
    ),
)
def _(spark, sf):
    return trends.country_series(enriched_events(spark, sf), "N3", JANUARY)


@register(
    "country_conflict_daily",
    on_events(
        f"""SELECT ActionGeo_CountryCode AS country_code, {_DAILY} FROM ev
        WHERE {since(90)} AND ActionGeo_CountryCode <> '' AND QuadClass IN (3, 4) GROUP BY ALL""".replace(
            "GROUP BY ALL", "GROUP BY ActionGeo_CountryCode, d"
        )
    ),
)
def _(spark, sf):
    return trends.country_conflict_daily(enriched_events(spark, sf))


_FEATURES = f"""SELECT ActionGeo_CountryCode AS country_code, SQLDATE::BIGINT AS SQLDATE, count(*) AS event_count,
  {r6(SHARE)} AS conflict_ratio, {r6('avg(GoldsteinScale)')} AS avg_goldstein, {r6('avg(AvgTone)')} AS avg_tone,
  sum(NumMentions)::BIGINT AS num_mentions_sum FROM ev WHERE {since(90)} AND ActionGeo_CountryCode <> ''
  GROUP BY ActionGeo_CountryCode, SQLDATE"""


@register("country_day_features", on_events(_FEATURES))
def _(spark, sf):
    return trends.country_day_features(enriched_events(spark, sf))


@register(
    "top_countries",
    on_events(
        f"""SELECT ActionGeo_CountryCode AS country_code, count(*) AS event_count FROM ev
        WHERE {since(7)} AND ActionGeo_CountryCode <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
    ),
)
def _(spark, sf):
    return trends.top_countries(enriched_events(spark, sf), 7, 10)


def _volumes(days):
    sql = on_events(
        f"""SELECT ActionGeo_CountryCode AS country_code, count(*) AS event_count,
        {r6('avg(GoldsteinScale)')} AS avg_goldstein, {r6('avg(AvgTone)')} AS avg_tone FROM ev
        WHERE {since(days)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"""
    )

    @register(f"country_volumes_{days}d", sql)
    def _(spark, sf):
        return trends.country_volumes(enriched_events(spark, sf), days)


for _days in (1, 7, 30, 90):
    _volumes(_days)


@register(
    "quad_class_volumes",
    on_events(
        f"""SELECT QuadClass::BIGINT AS quad_class, count(*) AS event_count,
        {r6('avg(GoldsteinScale)')} AS avg_goldstein FROM ev WHERE {since(7)} GROUP BY 1"""
    ),
)
def _(spark, sf):
    return trends.quad_class_volumes(enriched_events(spark, sf))


@register(
    "conflict_ratios",
    on_events(
        f"""SELECT ActionGeo_CountryCode AS country_code, {r6(SHARE)} AS conflict_ratio,
        {r6('avg(GoldsteinScale)')} AS avg_goldstein, {r6('avg(AvgTone)')} AS avg_tone,
        sum(NumMentions)::BIGINT AS total_mentions FROM ev WHERE {since(30)} GROUP BY 1 HAVING count(*) > 10"""
    ),
)
def _(spark, sf):
    return trends.conflict_ratios(enriched_events(spark, sf))


@register(
    "top_conflict_series",
    on_events(
        f"""SELECT strftime(d, '%Y-%m-%d') AS ds, count(*) AS y FROM ev
        WHERE {since(90)} AND QuadClass IN (3, 4) AND ActionGeo_CountryCode = (
          SELECT ActionGeo_CountryCode FROM ev WHERE {since(90)} AND QuadClass IN (3, 4)
          AND ActionGeo_CountryCode IS NOT NULL
          GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY d"""
    ),
)
def _(spark, sf):
    return trends.top_conflict_series(enriched_events(spark, sf))


def _grid_sql(digits, where, limit):
    return f"""cells AS (SELECT round(ActionGeo_Lat, {digits}) + 0.0 AS lat, round(ActionGeo_Long, {digits}) + 0.0 AS lon,
      ActionGeo_CountryCode AS cc, count(*) AS n FROM ev WHERE {where} GROUP BY 1, 2, 3),
    grid AS (SELECT lat, lon, first(cc ORDER BY n DESC, cc) FILTER (cc IS NOT NULL) AS country_code, sum(n)::BIGINT AS intensity
      FROM cells GROUP BY 1, 2 ORDER BY 4 DESC, 1, 2 LIMIT {limit})"""


_GRID_ROWS = f"SELECT {r6('lat')} AS lat, {r6('lon')} AS lon, country_code, intensity FROM grid"


@register(
    "map_grid_world",
    on_events(_GRID_ROWS, _grid_sql(0, f"{IN_JANUARY} AND ActionGeo_Lat BETWEEN -90 AND 90", "ALL")),
)
def _(spark, sf):
    return trends.map_grid(enriched_events(spark, sf), WORLD, JANUARY, rows.grid_digits(0.5))


@register(
    "map_grid_region",
    on_events(
        _GRID_ROWS,
        _grid_sql(
            2,
            f"{IN_JANUARY} AND ActionGeo_Lat BETWEEN -40 AND 40 AND ActionGeo_Long BETWEEN -60 AND 60",
            1000,
        ),
    ),
)
def _(spark, sf):
    box = rows.snap_box({"north": 39.0, "south": -36.5, "east": 57.0, "west": -58.0}, 3.5)
    return trends.map_grid(enriched_events(spark, sf), box, JANUARY.with_(limit=1000), rows.grid_digits(3.5))


_CATEGORY = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(upper(theme), '{t}')" for t in tokens) + f" THEN '{category}'"
    for category, tokens in THEME_CATEGORIES.items()
) + " END"


@register(
    "theme_category_counts",
    on_events(
        f"""SELECT k.category, coalesce(n, 0) AS event_count FROM known k LEFT JOIN
        (SELECT {_CATEGORY} AS category, count(*) AS n FROM themed GROUP BY 1) c ON c.category = k.category""",
        f"themed AS (SELECT unnest(themes) AS theme FROM ev WHERE {since(7)})",
        f"known AS (SELECT unnest({list(THEME_CATEGORIES)}) AS category)",
    ),
)
def _(spark, sf):
    return trends.theme_category_counts(enriched_events(spark, sf))


@register(
    "ingestion_stats",
    on_events(
        """SELECT count(*) AS total_rows, count(DISTINCT SQLDATE) AS coverage_days,
        strftime(max(d), '%Y-%m-%dT00:00:00') AS last_updated_at FROM ev"""
    ),
)
def _(spark, sf):
    return trends.ingestion_stats(enriched_events(spark, sf))


@register(
    "row_volume",
    on_events(
        """SELECT count(*) AS total_rows, min(SQLDATE)::BIGINT AS oldest_sqldate, max(SQLDATE)::BIGINT AS newest_sqldate,
        greatest(1, max(d) - min(d))::BIGINT AS days_of_data,
        round(count(*)::DOUBLE / greatest(1, max(d) - min(d)))::BIGINT AS rows_per_day FROM ev"""
    ),
)
def _(spark, sf):
    return quality.row_volume(enriched_events(spark, sf))


@register("storage_metrics")
def _(spark, sf):
    stored = table(spark, sf, "events")
    day = F.year("ts") * 10000 + F.month("ts") * 100 + F.day("ts")
    return quality.storage_metrics(stored.withColumn("SQLDATE", day))


@register(
    "quality_funnel",
    on_events(
        """, copies AS (SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE QuadClass = 4),
        one AS (SELECT GLOBALEVENTID, max(struct_pack(SQLDATE, EventRootCode,
            g := CASE WHEN NumSources = 9 THEN 'bad' ELSE GoldsteinScale::VARCHAR END,
            m := CASE WHEN NumSources <> 8 THEN NumMentions END)) AS k, count(*) AS copies
          FROM copies GROUP BY 1)
        SELECT sum(copies)::BIGINT AS raw_rows, count(*) AS distinct_events,
          count(*) FILTER (k.m IS NOT NULL) AS complete,
          count(*) FILTER (k.m IS NOT NULL AND k.g <> 'bad') AS typed,
          count(*) FILTER (k.m >= 3 AND k.g <> 'bad') AS mentioned,
          count(*) FILTER (k.m >= 3 AND k.g <> 'bad' AND TRY_CAST(k.g AS DOUBLE) BETWEEN -10 AND 10) AS kept
        FROM one"""
    ).replace("\n, copies AS", ", copies AS"),
)
def _(spark, sf):
    events = enriched_events(spark, sf)
    copies = events.unionByName(events.where(F.col("QuadClass") == 4))
    broken = copies.withColumns(
        {
            "GoldsteinScale": F.when(F.col("NumSources") == 9, "bad").otherwise(
                F.col("GoldsteinScale").cast("string")
            ),
            "NumMentions": F.when(F.col("NumSources") != 8, F.col("NumMentions")),
        }
    )
    return quality.quality_funnel(broken)


@register(
    "clean_events",
    on_events("SELECT GLOBALEVENTID, NumMentions FROM ev WHERE NumMentions >= 3"),
)
def _(spark, sf):
    events = enriched_events(spark, sf)
    copies = events.unionByName(events.where("QuadClass = 4").withColumn("NumMentions", F.lit(0).cast("bigint")))
    return quality.clean_events(copies).select("GLOBALEVENTID", "NumMentions")


# --- people and sources ---------------------------------------------------------------

_PEOPLE = f"people AS (SELECT GLOBALEVENTID, NumMentions, unnest(persons) AS name FROM ev WHERE {since(7)})"


def _people(metric, measure):
    sql = on_events(
        f"SELECT name, {measure} AS count FROM people WHERE name <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", _PEOPLE
    )

    @register(f"top_people_{metric}", sql)
    def _(spark, sf):
        return entities.top_people(enriched_events(spark, sf), EventFilter(), metric=metric)


for _metric, _measure in {
    "mentions": "sum(NumMentions)::BIGINT", "events": "count(DISTINCT GLOBALEVENTID)", "rows": "count(*)"
}.items():
    _people(_metric, _measure)


@register(
    "top_sources",
    on_events(
        f"""SELECT name, count(*) AS count FROM (SELECT split_part(replace(replace(replace(lower(SOURCEURL),
          'https://', ''), 'http://', ''), 'www.', ''), '/', 1) AS name FROM ev WHERE {IN_JANUARY} AND SOURCEURL <> '')
        WHERE name <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"""
    ),
)
def _(spark, sf):
    return entities.top_sources(enriched_events(spark, sf, urls=True), JANUARY, 25)


def _region_sql(source):
    return on_events(
        f"""SELECT kind, rank, name, count FROM (SELECT kind, name, count(*) AS count,
          row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, name) AS rank FROM (
            SELECT 'themes' AS kind, unnest(themes) AS name FROM r UNION ALL
            SELECT 'persons', unnest(persons) FROM r UNION ALL
            SELECT 'organizations', unnest(organizations) FROM r) GROUP BY kind, name) WHERE rank <= 10""",
        f"r AS ({source})",
    )


_IN_NATION_7 = f"SELECT * FROM ev WHERE {IN_JANUARY} AND (Actor1CountryCode = 'NATION_7' OR ActionGeo_CountryCode = 'NATION_7')"


@register("region_entities", _region_sql(_IN_NATION_7))
def _(spark, sf):
    return entities.region_entities(enriched_events(spark, sf), "NATION_7", JANUARY)


@register(
    "region_entities_newest",
    _region_sql(_IN_NATION_7 + " ORDER BY SQLDATE DESC, GLOBALEVENTID DESC LIMIT 2000"),
)
def _(spark, sf):
    return entities.region_entities(enriched_events(spark, sf), "NATION_7", JANUARY, newest=2000)


# --- risk -----------------------------------------------------------------------------


@register(
    "country_risk",
    on_events(
        f"""SELECT 'NATION_3' AS country_code, total_events, {r6('cr')} AS conflict_ratio, {r6('gs')} AS avg_goldstein,
        {r6('tone')} AS avg_tone, total_mentions, {score('cr', 'gs', 'tone')} AS score FROM (
          SELECT count(*) AS total_events, CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE {SHARE} END AS cr,
            avg(GoldsteinScale) AS gs, avg(AvgTone) AS tone, coalesce(sum(NumMentions), 0)::BIGINT AS total_mentions
          FROM ev WHERE {IN_JANUARY} AND ActionGeo_CountryCode = 'NATION_3')"""
    ),
)
def _(spark, sf):
    return risk.country_risk(enriched_events(spark, sf), "nation_3", JANUARY)


_STATS = f"""stats AS (SELECT ActionGeo_CountryCode AS country_code, count(*) AS total_events, {SHARE} AS cr,
  avg(GoldsteinScale) AS gs, avg(AvgTone) AS tone, count(AvgTone) AS tone_rows, {CONFLICT} AS conflicts,
  sum(AvgTone) AS tone_sum FROM ev WHERE {IN_JANUARY} AND ActionGeo_CountryCode <> '' GROUP BY 1)"""


@register(
    "global_pulse",
    on_events(
        f"""SELECT (SELECT sum(total_events)::BIGINT FROM stats) AS total_events, a.country_code AS most_active_country,
        {display('a.country_code', 'an.name')} AS most_active_display, a.total_events AS most_active_count,
        h.country_code AS most_hostile_country, {display('h.country_code', 'hn.name')} AS most_hostile_display,
        (SELECT {r6('sum(tone_sum) / sum(tone_rows)')} FROM stats) AS avg_global_tone,
        (SELECT {r6('sum(conflicts)::DOUBLE / sum(total_events)::DOUBLE')} FROM stats) AS global_conflict_ratio
        FROM (SELECT * FROM stats ORDER BY total_events DESC, country_code LIMIT 1) a
        CROSS JOIN (SELECT * FROM stats WHERE tone_rows >= 10 ORDER BY tone, country_code LIMIT 1) h
        LEFT JOIN names an ON an.code = a.country_code LEFT JOIN names hn ON hn.code = h.country_code""",
        _STATS,
        NAMES_VIEW,
    ),
)
def _(spark, sf):
    return risk.global_pulse(enriched_events(spark, sf), JANUARY, country_names(spark, sf))


_SCORED = f"""scored AS (SELECT *, {score('cr', 'gs', 'tone')} AS score
  FROM stats)"""


@register(
    "top_threats",
    on_events(
        f"""SELECT country_code, name AS country_name, {display('country_code', 'name')} AS country_display, score,
        CASE WHEN score > 70 THEN 'CRITICAL' WHEN score > 50 THEN 'ELEVATED' WHEN score > 30 THEN 'MODERATE'
          ELSE 'LOW' END AS band, {r6('cr')} AS conflict_ratio, total_events
        FROM (SELECT * FROM scored ORDER BY score DESC, total_events DESC, country_code LIMIT 5)
        LEFT JOIN names ON code = country_code""",
        _STATS,
        _SCORED,
        NAMES_VIEW,
    ),
)
def top_threats(spark, sf):
    return risk.top_threats(enriched_events(spark, sf), JANUARY, country_names(spark, sf))


@register(
    "median_threat_score",
    on_events(f"SELECT {r6('median(score)')} AS median_score FROM scored", _STATS, _SCORED),
)
def _(spark, sf):
    threats = risk.top_threats(enriched_events(spark, sf), JANUARY, country_names(spark, sf), limit=None)
    return risk.median_score(threats)


def _delta_sql(oldest, split):
    def part(name, test):
        return f"""count(*) FILTER ({test}) AS e_{name},
        count(*) FILTER ({test} AND QuadClass IN (3, 4)) AS c_{name},
        avg(GoldsteinScale) FILTER ({test}) AS g_{name}, coalesce(avg(AvgTone) FILTER ({test}), 0) AS t_{name}"""

    def share(name):
        return f"CASE WHEN e_{name} = 0 THEN 0.0::DOUBLE ELSE c_{name}::DOUBLE / e_{name} END"

    return on_events(
        f"""SELECT country_code,
        round_even((e_now - e_before)::DOUBLE / greatest(1, e_before) * 100, 1) + 0.0 AS event_delta_pct,
        round_even((s_now - s_before) * 100, 1) + 0.0 AS conflict_delta,
        round_even(t_now - t_before, 1) + 0.0 AS tone_delta,
        {score('s_now', 'g_now', 't_now')} - {score('s_before', 'g_before', 't_before')} AS score_delta
        FROM (SELECT *, {share('now')} AS s_now, {share('before')} AS s_before FROM windows)""",
        f"""windows AS (SELECT ActionGeo_CountryCode AS country_code, count(*) AS n,
          {part('now', f'd >= {ANCHOR} - {split}')}, {part('before', f'd < {ANCHOR} - {split}')}
          FROM ev WHERE {since(oldest)} AND ActionGeo_CountryCode <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)""",
    )


@register("weekly_deltas", _delta_sql(14, 7))
def _(spark, sf):
    return risk.weekly_deltas(enriched_events(spark, sf))


@register("weekly_deltas_even_weeks", _delta_sql(13, 6))
def _(spark, sf):
    return risk.weekly_deltas(enriched_events(spark, sf), symmetric=True)


_SPIKES = f"""codes AS (SELECT ActionGeo_CountryCode AS country_code, EventRootCode AS code,
    count(*) FILTER (d >= {ANCHOR} - 1) AS recent, count(*) FILTER (d < {ANCHOR} - 1) AS earlier
    FROM ev WHERE {since(8)} AND ActionGeo_CountryCode <> '' GROUP BY 1, 2),
  spikes AS (SELECT country_code, sum(recent)::BIGINT AS events_24h, sum(earlier)::DOUBLE / 7 AS baseline,
    first(code ORDER BY recent DESC, code) AS top_cameo_root FROM codes GROUP BY 1)"""
_IS_SPIKE = "baseline > 0 AND events_24h / baseline >= 2 AND events_24h >= 10"


@register(
    "activity_spikes",
    on_events(
        f"""SELECT country_code, name AS country_name, {display('country_code', 'name')} AS country_display, events_24h,
        round_even(baseline, 1) + 0.0 AS baseline_avg, round_even(events_24h / baseline, 2) + 0.0 AS spike_ratio,
        top_cameo_root FROM spikes LEFT JOIN names ON code = country_code WHERE {_IS_SPIKE}""",
        _SPIKES,
        NAMES_VIEW,
    ),
)
def _(spark, sf):
    return risk.activity_spikes(enriched_events(spark, sf), country_names(spark, sf))


def _flagged(events):
    """Countries with a high conflict share, standing in for the anomaly job's result."""
    ratios = trends.conflict_ratios(events)
    return ratios.select(
        "country_code",
        (F.col("conflict_ratio") > 0.4).alias("is_anomaly"),
        F.lit("Conflict ratio above 0.4").alias("reason"),
    )


_FLAGGED = f"""flagged AS (SELECT ActionGeo_CountryCode AS country_code, 'Conflict ratio above 0.4' AS reason
  FROM ev WHERE {since(30)} GROUP BY 1 HAVING count(*) > 10 AND {SHARE} > 0.4)"""


@register(
    "alerts",
    on_events(
        f"""SELECT country_code, 'spike' AS kind, NULL AS detail, round_even(events_24h / baseline, 2) + 0.0 AS spike_ratio
        FROM spikes WHERE {_IS_SPIKE} UNION ALL SELECT country_code, 'anomaly', reason, NULL FROM flagged
        WHERE country_code NOT IN (SELECT country_code FROM spikes WHERE {_IS_SPIKE})""",
        _SPIKES,
        _FLAGGED,
    ),
)
def _(spark, sf):
    events = enriched_events(spark, sf)
    found = risk.alerts(risk.activity_spikes(events, country_names(spark, sf)), _flagged(events))
    # The ratio's text form differs between engines, so it is compared as a number.
    spike = F.col("kind") == "spike"
    ratio = F.when(spike, F.col("detail").try_cast("double"))
    return found.withColumn("spike_ratio", ratio).withColumn("detail", F.when(~spike, F.col("detail")))


@register(
    "anomalous_cells",
    on_events(
        f"""SELECT {r6('lat')} AS lat, {r6('lon')} AS lon, grid.country_code, reason
        FROM grid JOIN flagged ON flagged.country_code = grid.country_code""",
        _grid_sql(0, f"{IN_JANUARY} AND ActionGeo_Lat BETWEEN -90 AND 90", "ALL"),
        _FLAGGED,
    ),
)
def _(spark, sf):
    events = enriched_events(spark, sf)
    return risk.anomalous_cells(trends.map_grid(events, WORLD, JANUARY, 0), _flagged(events))


# --- places ---------------------------------------------------------------------------

_PLACES = """places AS (SELECT c_custkey AS place_id,
    CASE WHEN c_custkey % 3 = 0 THEN (c_custkey * 7577 % 16301) / 100 - 81.503::DOUBLE
      ELSE (c_nationkey * 7 % 160 - 80) + (c_custkey * 37 % 997) / 1000 END AS lat,
    CASE WHEN c_custkey % 3 = 0 THEN (c_custkey * 15373 % 35603) / 100 - 178.017::DOUBLE
      ELSE (c_nationkey * 29 % 340 - 170) + (c_custkey * 53 % 691) / 1000 END AS lon,
    'C' || c_nationkey AS country_code,
    'State ' || (c_custkey % 17) AS state, 'City ' || (c_custkey % 101) AS city FROM customer),
  points AS (SELECT DISTINCT ActionGeo_Lat AS lat, ActionGeo_Long AS lon FROM ev),
  on_globe AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y,
    sin(radians(lat)) AS z FROM places),
  located AS (SELECT lat, lon, place_id, country_code, state, city FROM (
    SELECT p.lat, p.lon, place_id, country_code, state, city, row_number() OVER (PARTITION BY p.lat, p.lon ORDER BY
      floor(1e12 * ((px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2)), place_id) AS nth
    FROM (SELECT lat, lon, cos(radians(lat)) * cos(radians(lon)) AS px, cos(radians(lat)) * sin(radians(lon)) AS py,
      sin(radians(lat)) AS pz FROM points) p CROSS JOIN on_globe) WHERE nth = 1)"""


@register(
    "nearest_places",
    on_events(
        f"SELECT {r6('lat')} AS lat, {r6('lon')} AS lon, place_id, country_code, state, city FROM located", _PLACES
    ),
)
def _(spark, sf):
    return geo.nearest_places(geo.event_points(enriched_events(spark, sf)), places(spark, sf))


#: Folders of the stored indexes, by application and data folder: an index is written once and read by every search.
_INDEXES: dict[tuple[str, str], str] = {}


@register("nearest_places_indexed", ORACLE["nearest_places"])
def _(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        folder = work_dir(spark, "place-index")
        geo.write_place_index(places(spark, sf), folder)
        _INDEXES[key] = folder
    return geo.nearest_places(geo.event_points(enriched_events(spark, sf)), geo.read_place_index(spark, _INDEXES[key]))


@register(
    "events_in_place",
    on_events(
        f"""SELECT {EVENT_FIELDS} FROM ev JOIN (SELECT lat, lon FROM located WHERE lower(state) = 'state 5') here
        ON ActionGeo_Lat = lat AND ActionGeo_Long = lon WHERE {IN_JANUARY}""",
        _PLACES,
    ),
)
def _(spark, sf):
    f = JANUARY.with_(geo_state=" STATE 5 ")
    return rows.list_events(enriched_events(spark, sf, urls=True), f, places(spark, sf))


@register(
    "drill_countries",
    on_events(
        f"""SELECT coalesce(name, code0) AS name, code0 AS code, {display('code0', 'name')} AS display, count
        FROM (SELECT ActionGeo_CountryCode AS code0, count(*) AS count FROM ev WHERE {IN_JANUARY} GROUP BY 1
          ORDER BY 2 DESC, 1 LIMIT 40) LEFT JOIN names ON code = code0""",
        NAMES_VIEW,
    ),
)
def _(spark, sf):
    return geo.drill_countries(enriched_events(spark, sf), JANUARY, country_names(spark, sf))


def _drill_sql(level, extra, limit):
    return on_events(
        f"""SELECT {level} AS name, count(*) AS count FROM ev JOIN located ON ActionGeo_Lat = lat AND ActionGeo_Long = lon
        WHERE {IN_JANUARY} AND ActionGeo_CountryCode = 'NATION_6' {extra} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}""",
        _PLACES,
    )


@register("drill_states", _drill_sql("state", "", 20))
def _(spark, sf):
    return geo.drill_places(enriched_events(spark, sf), JANUARY, places(spark, sf), "nation_6")


@register("drill_cities", _drill_sql("city", "AND state = 'State 8'", 15))
def _(spark, sf):
    return geo.drill_places(enriched_events(spark, sf), JANUARY, places(spark, sf), "nation_6", "State 8")


@register(
    "drill_available",
    on_events(
        f"""SELECT count(*) > 0 AS state_available, CASE WHEN count(*) = 0 THEN
        'State drill needs the latitude and longitude of the action; load newer data.' END AS state_reason
        FROM ev WHERE {IN_JANUARY} AND ActionGeo_CountryCode = 'NATION_6' AND ActionGeo_Lat IS NOT NULL"""
    ),
)
def _(spark, sf):
    return geo.drill_available(enriched_events(spark, sf), JANUARY, "nation_6")


# --- tiers ----------------------------------------------------------------------------

CUTOFF = date(2024, 1, 15)


def _tiers(spark, sf, urls=False):
    """The event view as two tiers that overlap for some days; the cold one has no lists."""
    events = enriched_events(spark, sf, urls=urls)
    hot = events.where(F.col("SQLDATE") >= 20240112)
    cold = events.where(F.col("SQLDATE") < 20240118).drop("themes", "persons", "organizations")
    return hot, cold


@register("tier_daily_merge", on_events(f"SELECT {_DAILY} FROM ev WHERE {IN_JANUARY} GROUP BY d"))
def _(spark, sf):
    hot, cold = _tiers(spark, sf)
    recent, older = tiers.split_filter(JANUARY, CUTOFF)
    return tiers.merge_daily_counts(trends.daily_counts(hot, recent), trends.daily_counts(cold, older))


@register(
    "tier_daily_sums",
    on_events(
        f"""SELECT SQLDATE::BIGINT AS SQLDATE, count(*) AS count, {r6('avg(GoldsteinScale)')} AS avg_goldstein_scale,
        sum(NumMentions)::BIGINT AS total_mentions, {r6('avg(AvgTone)')} AS avg_tone FROM (
          SELECT * FROM ev WHERE SQLDATE >= 20240112 UNION ALL SELECT * FROM ev WHERE SQLDATE < 20240118)
        GROUP BY SQLDATE"""
    ),
)
def _(spark, sf):
    hot, cold = _tiers(spark, sf)
    return tiers.merge_daily_sums(tiers.daily_sums(hot), tiers.daily_sums(cold))


@register(
    "tier_grid_merge",
    on_events(
        f"""SELECT round(ActionGeo_Lat, 0) + 0.0 AS lat, round(ActionGeo_Long, 0) + 0.0 AS lon,
        count(*)::DOUBLE AS intensity FROM ev WHERE {IN_JANUARY} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 40"""
    ),
)
def _(spark, sf):
    hot, cold = _tiers(spark, sf)
    recent, older = tiers.split_filter(JANUARY, CUTOFF)
    grids = trends.map_grid(hot, WORLD, recent, 0), trends.map_grid(cold, WORLD, older, 0, normalize=False)
    return tiers.merge_grids(*grids, limit=40)


@register(
    "tier_rows_merge",
    on_events(
        f"""SELECT GLOBALEVENTID AS global_event_id, strftime(d, '%Y-%m-%d') AS sql_date,
        CASE WHEN SQLDATE >= 20240115 THEN {joined('themes')} ELSE '' END AS themes, SOURCEURL AS source_url
        FROM ev WHERE {IN_JANUARY} ORDER BY SQLDATE DESC, GLOBALEVENTID DESC LIMIT 5000"""
    ),
)
def _(spark, sf):
    hot, cold = _tiers(spark, sf, urls=True)
    empty = F.array().cast("array<string>")
    cold = cold.withColumns({c: empty for c in ("themes", "persons", "organizations")})
    recent, older = tiers.split_filter(JANUARY.with_(limit=5000), CUTOFF)
    merged = tiers.merge_rows(rows.list_events(hot, recent), rows.list_events(cold, older), 5000)
    return merged.select("global_event_id", "sql_date", "themes", "source_url")


@register(
    "tier_union",
    on_events(
        f"""SELECT SQLDATE::BIGINT AS SQLDATE, count(*) AS n, sum(CASE WHEN SQLDATE >= 20240115 THEN len(themes) ELSE 0 END)::BIGINT
        AS themes FROM ev GROUP BY SQLDATE"""
    ),
)
def _(spark, sf):
    merged = tiers.both_tiers(*_tiers(spark, sf), CUTOFF)
    return merged.groupBy("SQLDATE").agg(F.count("*").alias("n"), F.sum(F.size("themes")).alias("themes"))


@register(
    "tier_event_lookup",
    on_events(
        """SELECT GLOBALEVENTID AS global_event_id, strftime(d, '%Y-%m-%d') AS sql_date, '' AS themes
        FROM ev WHERE GLOBALEVENTID = 77"""
    ),
)
def _(spark, sf):
    hot, cold = _tiers(spark, sf)
    empty = F.array().cast("array<string>")
    cold = cold.withColumns({c: empty for c in ("themes", "persons", "organizations")})
    return tiers.event_from_tiers(hot, cold, 77).select("global_event_id", "sql_date", "themes")


# --- briefings ------------------------------------------------------------------------

_SUMMARY = f"""codes AS (SELECT ActionGeo_CountryCode AS cc, EventRootCode AS code, count(*) AS n FROM ev
    WHERE {since(7)} AND ActionGeo_CountryCode <> '' GROUP BY 1, 2),
  tops AS (SELECT cc, string_agg(code, ', ' ORDER BY nth) AS lead_codes FROM (SELECT cc, code,
    row_number() OVER (PARTITION BY cc ORDER BY n DESC, code) AS nth FROM codes) WHERE nth <= 5 GROUP BY 1),
  totals AS (SELECT ActionGeo_CountryCode AS country_code, count(*) AS event_count, avg(GoldsteinScale) AS gs,
    avg(AvgTone) AS tone, sum(NumMentions)::BIGINT AS total_mentions, sum(NumSources)::BIGINT AS total_sources
    FROM ev WHERE {since(7)} AND ActionGeo_CountryCode <> '' GROUP BY 1),
  summaries AS (SELECT *, 'Country ' || country_code || '. Recent events: ' || event_count || '. Avg Goldstein: '
    || printf('%.2f', round(gs, 2) + 0.0) || '. Avg tone: ' || printf('%.2f', round(tone, 2) + 0.0)
    || '. Total mentions: ' || total_mentions || '. Total sources: ' || total_sources || '. Top root codes: '
    || lead_codes || '.' AS summary FROM totals JOIN tops ON cc = country_code)"""


@register(
    "country_summaries",
    on_events(
        f"""SELECT country_code, event_count, {r6('gs')} AS avg_goldstein, {r6('tone')} AS avg_tone, total_mentions,
        total_sources, replace(lead_codes, ', ', '|') AS top_codes, summary FROM summaries""",
        _SUMMARY,
    ),
)
def _(spark, sf):
    return briefings.country_summaries(enriched_events(spark, sf))


_TEMPLATE = """'Geopolitical briefing for ' || country_code || ': ' || summary || ' Interpretation: monitor changes in tone, '
  || 'Goldstein score, and event mix for escalation or de-escalation signals.'"""
_POOR = "regexp_matches(lower(text), 'could refer to|without more context')"


@register(
    "country_briefings",
    on_events(
        f"""SELECT s.country_code, CASE WHEN text IS NOT NULL AND NOT {_POOR} THEN text ELSE {_TEMPLATE} END AS briefing,
        CASE WHEN text IS NULL THEN 'template' WHEN {_POOR} THEN 'template_after_check' ELSE 'supplied' END AS source,
        summary FROM (SELECT * FROM summaries ORDER BY event_count DESC, country_code LIMIT 30) s LEFT JOIN texts t
        ON t.code = s.country_code""",
        _SUMMARY,
        """texts AS (SELECT n_name AS code, 'On ' || n_name || ': ' || (['This could refer to many places.',
          'Without more context, no reading is safe.', 'A calm week.'])[(n_nationkey % 3 + 1)] AS text
          FROM nation WHERE n_nationkey % 4 <> 3)""",
    ),
)
def _(spark, sf):
    return briefings.country_briefings(enriched_events(spark, sf), briefing_texts(spark, sf))
