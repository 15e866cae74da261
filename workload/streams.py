"""Streaming queries: each runs a file stream to its end and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.session import work_dir
from newsloom.sources.demo_events import enriched_events, table
from newsloom.streaming import feeds
from workload.base import on_events, r6, register


def _event_stream(spark: SparkSession, sf: str, folder: str | None = None) -> DataFrame:
    """The event table as a stream, or the files of `folder` in its form."""
    schema = table(spark, sf, "events").schema
    landed = feeds.stream_files(spark, folder or sf, schema, pattern=None if folder else "events.parquet")
    # The table's times are taken as UTC, whatever the zone of the session.
    timed = F.expr("timestamp(convert_timezone('UTC', current_timezone(), ts))").alias(feeds.EVENT_TIME)
    return enriched_events(spark, sf, False, landed, timed)


def _run(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    out = work_dir(spark, name)
    feeds.append_to(rows, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    written = spark.read.schema(rows.schema).parquet(f"{out}/rows")
    utc = {
        name: F.expr(f"convert_timezone(current_timezone(), 'UTC', CAST({name} AS TIMESTAMP_NTZ))")
        for name, kind in written.dtypes
        if kind == "timestamp"
    }
    return written.withColumns(utc) if utc else written


@register("stream_first_seen", on_events("SELECT GLOBALEVENTID, SQLDATE::BIGINT AS SQLDATE FROM ev"))
def _(spark, sf):
    twice = _event_stream(spark, sf).union(_event_stream(spark, sf))
    once = feeds.first_seen(twice).select("GLOBALEVENTID", "SQLDATE")
    return _run(spark, once, "first-seen")


_UPSERTED = on_events(
    """SELECT strftime(d, '%Y-%m-%d') AS event_date, count(*) AS n, sum(NumMentions)::BIGINT AS mentions
    FROM ev GROUP BY d"""
)


def _upserted(spark: SparkSession, sf: str) -> str:
    """Three landings: a fifth of the events is missing at first, others lack properties or stand at a wrong day.

    Events 0, 6, 12 .. come three days late at first, and are put right by the second landing; every ninth wanders again,
    and comes back with the third.
    """
    out, raw = work_dir(spark, "upsert"), table(spark, sf, "events")
    shifted = F.expr("ts + INTERVAL 3 DAYS")
    early = raw.where("event_id % 5 <> 0").withColumn("props", F.expr("if(event_id % 2 = 0, NULL, props)"))
    early = early.withColumn("ts", F.when(F.expr("event_id % 6 = 0"), shifted).otherwise(F.col("ts")))
    second = raw.where("event_id % 5 = 0 OR event_id % 2 = 0")
    second = second.withColumn("ts", F.when(F.expr("event_id % 9 = 0"), shifted).otherwise(F.col("ts")))
    for landing in (early, second, raw.where("event_id % 9 = 0")):
        landing.write.mode("append").parquet(f"{out}/landed")
        events = _event_stream(spark, sf, f"{out}/landed").drop("event_date")
        feeds.upsert_stream(events, f"{out}/days", f"{out}/checkpoint").start().awaitTermination()
    return f"{out}/days"


def _per_day(stored: DataFrame) -> DataFrame:
    return stored.groupBy("event_date").agg(F.count("*").alias("n"), F.sum("NumMentions").alias("mentions"))


@register("stream_upsert", _UPSERTED)
def _(spark, sf):
    return _per_day(feeds.read_upserted(spark, _upserted(spark, sf)))


@register("stream_upsert_compacted", _UPSERTED)
def _(spark, sf):
    """The same after its days, keys and tombstones are merged and what they supersede is deleted."""
    path = _upserted(spark, sf)
    feeds.compact_upserted(spark, path)
    feeds.retire_upserted(spark, path)
    return _per_day(feeds.read_upserted(spark, path))


@register("stream_late_repeats", on_events("SELECT GLOBALEVENTID, SQLDATE::BIGINT AS SQLDATE, NumMentions FROM ev"))
def _(spark, sf):
    """A second landing repeats every seventh event ten days late and brings the events that the first lacked."""
    out, raw = work_dir(spark, "late"), table(spark, sf, "events")
    late = raw.where("event_id % 7 = 0 AND event_id % 11 <> 0").withColumns(
        {"ts": F.expr("ts + INTERVAL 10 DAYS"), "props": F.lit('{"k": 5000}')}
    )
    for landing in (raw.where("event_id % 11 <> 0"), late.unionByName(raw.where("event_id % 11 = 0"))):
        landing.write.mode("append").parquet(f"{out}/landed")
        events = _event_stream(spark, sf, f"{out}/landed").drop("event_date")
        feeds.unseen_stream(events, f"{out}/days", f"{out}/checkpoint").start().awaitTermination()
    return feeds.read_upserted(spark, f"{out}/days").select("GLOBALEVENTID", "SQLDATE", "NumMentions")


@register(
    "stream_country_counts",
    on_events(
        f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
        strftime(w + INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_end, country_code, count(*) AS event_count,
        {r6('avg(AvgTone)')} AS avg_tone FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS w,
          ActionGeo_CountryCode AS country_code, AvgTone FROM ev WHERE ActionGeo_CountryCode <> '')
        WHERE w + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR GROUP BY w, country_code"""
    ),
)
def _(spark, sf):
    return _run(spark, feeds.country_counts(_event_stream(spark, sf)), "country-counts")


@register(
    "stream_spike_alerts",
    on_events(
        f"""SELECT strftime(as_of, '%Y-%m-%d %H:%M:%S') AS as_of, country_code, events_24h,
        {r6('earlier / 7')} AS baseline_avg, {r6('events_24h / (earlier / 7)')} AS spike_ratio FROM (
          SELECT as_of, ActionGeo_CountryCode AS country_code,
            count(*) FILTER (ts >= as_of - INTERVAL 1 DAY) AS events_24h,
            (count(*) FILTER (ts < as_of - INTERVAL 1 DAY))::DOUBLE AS earlier
          FROM ev JOIN (SELECT DISTINCT CAST(d + shift AS TIMESTAMP) AS as_of FROM ev
            CROSS JOIN (SELECT unnest(range(1, 9))::INT AS shift)) ON ts >= as_of - INTERVAL 8 DAY AND ts < as_of
          WHERE ActionGeo_CountryCode <> '' AND as_of <= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR GROUP BY 1, 2)
        WHERE earlier > 0 AND events_24h >= 10 AND events_24h / (earlier / 7) >= 2"""
    ),
)
def _(spark, sf):
    return _run(spark, feeds.spike_alerts(_event_stream(spark, sf)), "spike-alerts")
