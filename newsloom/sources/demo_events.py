"""The enriched event table derived from the driver's test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.schema import ACTOR_TYPE_LABELS, PARTITION_COLUMN

# Names the derived list columns are drawn from.
THEMES = (
    "ELECTIONS",
    "WB_635_PUBLIC_HEALTH",
    "ECON_TRADE",
    "ENV_CLIMATE",
    "TAX_MILITARY",
    "TERROR",
    "CYBER_ATTACK",
    "ENERGY_OIL",
    "HUMAN_RIGHTS",
    "TAX_FNCACT_LEADER",
    "NATURAL_DISASTER",
    "CRISISLEX_C07_SAFETY",
    "SOC_PROTEST",
)
PERSONS = (
    "Ada Berg",
    "Bo Castro",
    "Cai Dubois",
    "Dia Eklund",
    "Eli Farah",
    "Fay Gomez",
    "Gus Haddad",
    "Hal Ito",
    "Ida Jansen",
    "Jon Kim",
    "Kay Lund",
)
ORGANIZATIONS = ("UN", "EU", "WHO", "NATO", "IMF", "OPEC", "AU")
QUAD_CLASS_OF_TYPE = {"signup": 1, "view": 1, "purchase": 2, "click": 3, "error": 4}


# Schemas given to the reader, which then opens no file before the query runs.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def pick(names, index: str) -> str:
    """SQL text of the name at `index`, counted round and round."""
    listed = ", ".join(f"'{name}'" for name in names)
    return f"element_at(array({listed}), int(({index}) % {len(names)} + 1))"


def _two_of(names, spread: int) -> str:
    chosen = f"array({pick(names, 'event_id')}, {pick(names, f'event_id div {spread}')})"
    return f"if(event_id % 6 = 0, array(), {chosen})"


def page_key(pages: DataFrame, key: Column) -> Column:
    """Id of the page that belongs to a key: the key modulo the range of page ids."""
    return key % pages.agg((F.max("page_id") + 1).alias("n")).scalar()


def _columns() -> dict[str, str]:
    types = sorted(ACTOR_TYPE_LABELS)
    quad = " ".join(f"WHEN '{kind}' THEN {number}" for kind, number in QUAD_CLASS_OF_TYPE.items())
    root = "lpad(string(event_id % 20 + 1), 2, '0')"
    second = "if(event_id % 11 <> 0, concat('N', event_id % 23), NULL)"
    return {
        "GLOBALEVENTID": "event_id",
        "SQLDATE": "year(ts) * 10000 + month(ts) * 100 + day(ts)",
        "MonthYear": "year(ts) * 100 + month(ts)",
        "Year": "year(ts)",
        "Actor1CountryCode": "concat('N', event_id % 25)",
        "Actor2CountryCode": second,
        "Actor1Type1Code": pick(types, "event_id"),
        "Actor2Type1Code": f"if(event_id % 5 <> 0, {pick(types, 'event_id div 3')}, NULL)",
        "EventCode": f"concat({root}, '0')",
        "EventBaseCode": root,
        "EventRootCode": root,
        "QuadClass": f"CASE event_type {quad} END",
        "GoldsteinScale": "event_id * 7919 % 201 / 10D - 10D",
        "NumMentions": r"""try_cast(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT)""",
        "NumSources": "event_id % 9 + 1",
        "AvgTone": "greatest(-30D, 10D - value / 5D)",
        "Actor1Geo_CountryCode": "concat('N', event_id % 25)",
        "Actor2Geo_CountryCode": second,
        "ActionGeo_CountryCode": "n_name",
        "ActionGeo_Lat": "place * 7 % 160 - 80 + event_id % 10 / 10D",
        "ActionGeo_Long": "place * 29 % 340 - 170 + event_id % 7 / 10D",
        "SOURCEURL": "url",
        "themes": _two_of(THEMES, 13),
        "persons": _two_of(PERSONS, 11),
        "organizations": _two_of(ORGANIZATIONS, 7),
        "mentions_count": "event_id % 13",
        "avg_confidence": "if(event_id % 7 <> 0, event_id % 10 * 10D, NULL)",
        PARTITION_COLUMN: "to_date(ts)",
    }


def enriched_events(
    spark: SparkSession, sf_dir: str, urls: bool = False, events: DataFrame | None = None, *keep: Column
) -> DataFrame:
    """27 columns plus the date column. `urls` joins the page table for SOURCEURL.

    `events` may replace the event table, by a stream of it for instance.
    """
    events = table(spark, sf_dir, "events") if events is None else events
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = events.withColumn("place", F.expr("user_id % 25"))
    rows = rows.join(nation, F.expr("place = n_nationkey"), "left")
    if urls:
        pages = table(spark, sf_dir, "pages").select("page_id", "url")
        rows = rows.withColumn("source_page", page_key(pages, F.col("event_id")))
        rows = rows.join(pages, F.expr("source_page = page_id"), "left")
    else:
        rows = rows.withColumn("url", F.expr("string(NULL)"))
    return rows.select(*(F.expr(f"{text} AS {name}") for name, text in _columns().items()), *keep)


def country_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country lookup (code, name); the last nations have no name."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.where(F.col("n_nationkey") < 20).select(
        F.col("n_name").alias("code"),
        F.concat("r_name", F.lit(" "), F.col("n_nationkey")).alias("name"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table of places for reverse geocoding, one per customer.

    Two of three lie among the events of a nation, the others anywhere.
    """
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    near_lat = (nation * 7 % 160 - 80) + (key * 37 % 997) / F.lit(1000.0)
    near_lon = (nation * 29 % 340 - 170) + (key * 53 % 691) / F.lit(1000.0)
    far = key % 3 == 0
    return table(spark, sf_dir, "customer").select(
        key.alias("place_id"),
        F.when(far, (key * 7577 % 16301) / F.lit(100.0) - 81.503).otherwise(near_lat).alias("lat"),
        F.when(far, (key * 15373 % 35603) / F.lit(100.0) - 178.017).otherwise(near_lon).alias("lon"),
        F.concat(F.lit("C"), nation).alias("country_code"),
        F.concat(F.lit("State "), key % 17).alias("state"),
        F.concat(F.lit("City "), key % 101).alias("city"),
    )
