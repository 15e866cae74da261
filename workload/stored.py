"""Queries over the stored table: written by day, read back with day filters, cached."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.operators import quality, risk, rows, trends
from newsloom.schema import EVENT_POSITIONS
from newsloom.session import work_dir
from newsloom.sources import backfill, demo_feeds, store
from newsloom.sources.demo_events import country_names, enriched_events
from workload.base import ANCHOR, EVENT_FIELDS, ORACLE, on_events, register
from workload.feeds import _MENTIONS
from workload.reports import JANUARY


def _stored(spark: SparkSession, sf: str, urls: bool = False) -> str:
    """The events as a table partitioned by day in the work folder."""
    path = f"{work_dir(spark, 'stored')}/days"
    store.write_days(enriched_events(spark, sf, urls=urls), path)
    return path


@register(
    "stored_days_replaced",
    on_events(f"SELECT {EVENT_FIELDS} FROM ev WHERE d < {ANCHOR} OR QuadClass IN (3, 4)"),
)
def _(spark, sf) -> DataFrame:
    path = _stored(spark, sf, urls=True)
    events = enriched_events(spark, sf, urls=True)
    newest = events.agg(F.max("SQLDATE")).first()[0]
    store.write_days(events.where((F.col("SQLDATE") == newest) & F.col("QuadClass").isin(3, 4)), path)
    return store.read_events(spark, path).select(rows.event_columns())


@register("stored_daily_counts", ORACLE["daily_counts"])
def _(spark, sf) -> DataFrame:
    return trends.daily_counts(store.read_events(spark, _stored(spark, sf)), JANUARY)


@register("stored_top_threats", ORACLE["top_threats"])
def _(spark, sf) -> DataFrame:
    return risk.top_threats(store.read_events(spark, _stored(spark, sf)), JANUARY, country_names(spark, sf))


@register("cached_daily_counts", ORACLE["daily_counts"])
def _(spark, sf) -> DataFrame:
    counts, path = trends.daily_counts(enriched_events(spark, sf), JANUARY), work_dir(spark, "cache")
    store.write_cache(counts, path, "json")
    return store.read_cache(spark, path, counts.schema, "json")


#: Days of the backfill, and the one of them that comes with broken ids at first.
BACKFILLED = [date(2024, 1, day) for day in range(1, 6)]
POISONED = BACKFILLED[2]


@register(
    "backfill_ledger",
    on_events(
        f"""SELECT strftime(d, '%Y-%m-%d') AS event_date, attempt::BIGINT AS attempt, state, CASE WHEN state = 'stored' THEN n END AS rows,
          CASE WHEN state = 'failed' THEN 'event without a numeric id: ' || bad || ' rows' END AS problem,
          n AS stored_rows, mentions AS stored_mentions FROM (
            SELECT d, count(*) AS n, count(*) FILTER (GLOBALEVENTID % 10 = 0) AS bad, sum(coalesce(mentions, 0))::BIGINT AS mentions
            FROM ev LEFT JOIN mention_stats ON id = GLOBALEVENTID WHERE d <= DATE '{BACKFILLED[-1]}' GROUP BY d)
        JOIN (VALUES (1, 'failed'), (2, 'stored'), (1, 'stored')) AS tried(attempt, state)
          ON (d = DATE '{POISONED}') = ((attempt, state) <> (1, 'stored'))""",
        _MENTIONS,
    ),
)
def _(spark, sf) -> DataFrame:
    """Two runs over five days, one of which has broken ids in the first: the second run stores only that one."""
    path = f"{work_dir(spark, 'backfill')}/days"
    events = enriched_events(spark, sf, urls=True).select(*EVENT_POSITIONS, "event_date")
    days = events.select("GLOBALEVENTID", "event_date")
    mentions = demo_feeds.mentions(spark, sf).join(days, "GLOBALEVENTID")
    documents = demo_feeds.documents(spark, sf).withColumn("event_date", F.explode(F.array(*map(F.lit, BACKFILLED))))
    broken = F.when((F.col("event_date") == POISONED) & (F.col("GLOBALEVENTID") % 10 == 0), "broken")
    landed = events.withColumn("GLOBALEVENTID", F.coalesce(broken, F.col("GLOBALEVENTID").cast("string")))
    for feed in (landed, events):
        backfill.backfill(feed, mentions, documents, BACKFILLED, path)
    stored = store.read_events(spark, path).groupBy("event_date").agg(
        F.count("*").alias("stored_rows"), F.sum("mentions_count").alias("stored_mentions")
    )
    return backfill.read_ledger(spark, path).drop("files", "bytes").join(stored, "event_date")


@register(
    "retired_buffer",
    on_events(
        """SELECT SQLDATE::BIGINT AS SQLDATE, count(*) AS n, count(*) FILTER (SQLDATE >= 20240120) AS buffered FROM ev GROUP BY 1"""
    ),
)
def _(spark, sf) -> DataFrame:
    """Buffered days that are stored leave the buffer; readers see every day once."""
    path, held = _stored_until(spark, sf, 20240120), work_dir(spark, "buffer")
    store.write_days(enriched_events(spark, sf).where("SQLDATE >= 20240115"), held)
    stored = store.read_events(spark, path)
    store.retire_buffer(spark, held, stored)
    buffer = store.read_events(spark, held)
    whole = store.with_buffer(stored.withColumn("held", F.lit(0)), buffer.withColumn("held", F.lit(1)))
    return whole.groupBy("SQLDATE").agg(F.count("*").alias("n"), F.sum("held").alias("buffered"))


def _stored_until(spark: SparkSession, sf: str, day: int) -> str:
    path = f"{work_dir(spark, 'stored')}/days"
    store.write_days(enriched_events(spark, sf).where(F.col("SQLDATE") < day), path)
    return path


@register(
    "storage_with_empty_file",
    on_events(
        """SELECT 1::BIGINT AS empty_files, count(*) AS total_rows, min(SQLDATE)::BIGINT AS oldest_sqldate,
        max(SQLDATE)::BIGINT AS newest_sqldate FROM ev"""
    ),
)
def _(spark, sf) -> DataFrame:
    """The stored table with a file that holds no row in one of its days."""
    path = _stored(spark, sf)
    stored = store.read_events(spark, path)
    nothing = stored.drop("event_date").limit(0).coalesce(1)
    nothing.write.mode("append").parquet(f"{path}/event_date={BACKFILLED[0]}")
    metrics = quality.storage_metrics(spark.read.parquet(path), backfill.stored_files(spark, path))
    return metrics.select("empty_files", "total_rows", "oldest_sqldate", "newest_sqldate")
