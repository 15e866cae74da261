"""Structured Streaming over landed events: dedupe, upsert, counts and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import DateType, LongType, StructField, StructType

from newsloom.functions.dates import number_day_col
from newsloom.plans.enrichment import ID, keep_last
from newsloom.plans.filters import has_country
from newsloom.schema import ENRICHED_SCHEMA, PARTITION_COLUMN
from newsloom.sources.batches import (
    SEQUENCE,
    commit,
    committed,
    is_table,
    merge_batches,
    read_batch,
    read_batches,
    remove,
    retire,
    write_batch,
)
from newsloom.sources.store import add_undated

EVENT_TIME = "event_time"
#: Ids of one range of the key table, as a power of two, and ranges that a batch names in its filter at most.
KEY_RANGE, KEY_RANGE_BITS, MOST_RANGES = "id_range", 20, 4096
#: Spark's folder for rows whose partition value is NULL.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
KEY_SHAPE = StructType([
    StructField(ID, LongType()), StructField("key_day", DateType()),
    StructField(KEY_RANGE, LongType()), StructField(SEQUENCE, LongType()),
])
TOMBSTONE_SHAPE = StructType([
    StructField(ID, LongType()), StructField(PARTITION_COLUMN, DateType()), StructField(SEQUENCE, LongType()),
])


def stream_files(
    spark: SparkSession, path: str, schema: StructType, form: str = "parquet",
    pattern: str | None = None, files_per_batch: int | None = None,
) -> DataFrame:
    """Files of a folder as a stream, as they land."""
    reader = spark.readStream.schema(schema).format(form)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def first_seen(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drops repeats of an event that arrive within the watermark delay.

    State holds the ids of that span only.
    """
    return events.withWatermark(EVENT_TIME, delay).dropDuplicatesWithinWatermark([ID])


def tombstones_path(path: str) -> str:
    return f"{path.rstrip('/')}_moved"


def keys_path(path: str) -> str:
    return f"{path.rstrip('/')}_keys"


def event_shape(schema: StructType = ENRICHED_SCHEMA) -> StructType:
    return StructType([*schema.fields, StructField(PARTITION_COLUMN, DateType()), StructField(SEQUENCE, LongType())])


def _own_last(batch: DataFrame, batch_id: int) -> DataFrame:
    """The rows of a batch with their day: one per event, the last; events without an id are one a day, as nothing else
    tells them apart. Rows without a day all stay, so that one pass over the batch finds them too.
    """
    rows = batch.withColumn(PARTITION_COLUMN, number_day_col(F.col("SQLDATE"))).withColumn(SEQUENCE, F.lit(batch_id).cast("bigint"))
    tie = F.struct("NumMentions", "NumSources", "SOURCEURL", "SQLDATE")
    unnamed = F.when(F.col(ID).isNull(), F.col(PARTITION_COLUMN))
    undated = F.when(F.col(PARTITION_COLUMN).isNull(), F.monotonically_increasing_id())
    keyed = rows.withColumn("unnamed", unnamed).withColumn("undated", undated)
    return keep_last(keyed, F.col(SEQUENCE), tie, key=(ID, "unnamed", "undated")).drop("unnamed", "undated")


def id_range(column: Column) -> Column:
    """The range of ids an id falls in. Ids rise over time, so a batch touches few ranges."""
    return F.shiftright(column, KEY_RANGE_BITS)


def known_days(spark: SparkSession, path: str, ids: DataFrame, last: int | None) -> DataFrame:
    """(id, day) of those `ids` that batches through `last` have stored, with the day they stand at now.

    Keys are partitioned by range of ids. The ranges that `ids` fall in are named in the filter, unless there are more than
    MOST_RANGES; so a batch reads the keys of its ranges, not those of all days.
    """
    keys = read_batches(spark, keys_path(path), KEY_SHAPE, KEY_RANGE, last)
    asked = ids.where(F.col(ID).isNotNull()).select(ID)
    ranges = [row[0] for row in asked.select(id_range(F.col(ID))).distinct().limit(MOST_RANGES + 1).collect()]
    if len(ranges) <= MOST_RANGES:
        keys = keys.where(F.col(KEY_RANGE).isin(ranges))
    return keys.join(asked, ID, "left_semi").groupBy(ID).agg(F.max_by("key_day", SEQUENCE).alias("key_day"))


def _write_keys(rows: DataFrame, path: str, number: int) -> None:
    named = rows.where(F.col(ID).isNotNull())
    keys = named.select(ID, F.col(PARTITION_COLUMN).alias("key_day"), id_range(F.col(ID)).alias(KEY_RANGE))
    write_batch(keys.sortWithinPartitions(ID), keys_path(path), KEY_RANGE, number)


def upsert_days(path: str):
    """`foreachBatch` function: add a batch to a table whose readers see the last row of an event, see `read_upserted`.

    Rows are stored by day and batch number. A table of keys beside it knows the day each event stands at; an event that
    comes with another day leaves a tombstone at the old one, which is not rewritten. A batch only ever replaces its own
    files and is visible once it is committed, last of all: one that is run again after a failure, wherever that one
    stopped, gives the same table, and of the stored rows only keys are read. Rows whose SQLDATE is no day are added to the
    table beside it, see `read_undated`.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # A batch is computed anew by each action, so all of it is written by one; the rest reads ids and days from its files.
        latest = _own_last(batch, batch_id)
        write_batch(latest, path, PARTITION_COLUMN, batch_id)
        written = read_batch(spark, path, latest.schema, PARTITION_COLUMN, batch_id)
        add_undated(written, path)
        remove(spark, f"{path.rstrip('/')}/{PARTITION_COLUMN}={NO_VALUE}")
        stored = written.where(F.col(PARTITION_COLUMN).isNotNull()).select(ID, PARTITION_COLUMN)
        if is_table(spark, keys_path(path)):
            known = known_days(spark, path, stored, batch_id - 1)
            left = stored.join(known, ID).where(F.col("key_day") != F.col(PARTITION_COLUMN))
            write_batch(left.select(ID, F.col("key_day").alias(PARTITION_COLUMN)), tombstones_path(path), PARTITION_COLUMN, batch_id)
        _write_keys(stored, path, batch_id)
        commit(spark, path, batch_id)

    return upsert


def append_unseen(path: str):
    """`foreachBatch` function: add the events of a batch that the table does not have, however long ago they came.

    `first_seen` forgets ids behind its watermark; the keys of the table do not. Of several rows of an event in a batch the last
    stays, as in `upsert_days`, whose tables this one is: stored by day and batch, repeatable, visible when committed.
    Rows without an id are one a day and batch and always new.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest = _own_last(batch, batch_id).persist()
        try:
            add_undated(latest, path)
            dated = latest.where(F.col(PARTITION_COLUMN).isNotNull())
            new = dated.join(known_days(spark, path, dated, batch_id - 1), ID, "left_anti")
            write_batch(new, path, PARTITION_COLUMN, batch_id)
            _write_keys(new, path, batch_id)
            commit(spark, path, batch_id)
        finally:
            latest.unpersist()

    return append


def _live(spark: SparkSession, path: str, rows: DataFrame, last: int | None) -> DataFrame:
    """`rows` without those whose event has moved to another day since."""
    if not is_table(spark, tombstones_path(path)):
        return rows
    gone = read_batches(spark, tombstones_path(path), TOMBSTONE_SHAPE, PARTITION_COLUMN, last)
    gone = gone.groupBy(PARTITION_COLUMN, ID).agg(F.max(SEQUENCE).alias("gone_at"))
    joined = rows.join(gone, [PARTITION_COLUMN, ID], "left")
    return joined.where(F.col("gone_at").isNull() | (F.col("gone_at") <= F.col(SEQUENCE))).select(rows.columns)


def read_upserted(spark: SparkSession, path: str, schema: StructType = ENRICHED_SCHEMA) -> DataFrame:
    """The table that `upsert_days` keeps: the last row of each event, with its day and batch number.

    An event stands at the day it came with last, and nowhere else. A filter on the day prunes partitions, of rows and of
    tombstones, before rows are compared. Batches that are not committed are not seen. A missing table is empty.
    """
    last = committed(spark, path)
    rows = read_batches(spark, path, event_shape(schema), PARTITION_COLUMN, last)
    return _last_of_day(_live(spark, path, rows, last))


def _last_of_day(rows: DataFrame, *first: Column, within: tuple[str, ...] = (PARTITION_COLUMN,)) -> DataFrame:
    """The last row of each event in each day, by batch, then by `first`; tombstones have taken it from all other days."""
    tie = F.struct("NumMentions", "NumSources", "SOURCEURL")
    return keep_last(rows, F.col(SEQUENCE), *first, tie, key=(*within, ID))


def _standing(rows: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """The last row of each event in each day, if it is a row (`stands`) and no later tombstone."""
    stands = F.coalesce("stands", F.lit(True))
    return _last_of_day(rows, stands, within=within).where(stands).drop("stands")


def compact_upserted(spark: SparkSession, path: str, schema: StructType = ENRICHED_SCHEMA, batches: int = 2) -> None:
    """Merges days that at least `batches` batches have added to, and likewise keys and tombstones; readers see the same rows.

    Runs beside readers and may stop anywhere. A day keeps its events' last rows only. `retire_upserted` then deletes
    what is superseded.
    """
    last = committed(spark, path)
    newest = F.max(SEQUENCE).alias(SEQUENCE)
    last_gone = lambda rows, within: rows.groupBy(*within, ID).agg(newest)
    last_key = lambda rows, within: rows.groupBy(*within, ID).agg(F.max_by("key_day", SEQUENCE).alias("key_day"), newest)
    gone = read_batches(spark, tombstones_path(path), TOMBSTONE_SHAPE, PARTITION_COLUMN, last).withColumn("stands", F.lit(False))
    merge_batches(spark, path, event_shape(schema), PARTITION_COLUMN, ID, _standing, last, batches, gone)
    merge_batches(spark, tombstones_path(path), TOMBSTONE_SHAPE, PARTITION_COLUMN, ID, last_gone, last, batches)
    merge_batches(spark, keys_path(path), KEY_SHAPE, KEY_RANGE, ID, last_key, last, batches)


def retire_upserted(spark: SparkSession, path: str, schema: StructType = ENRICHED_SCHEMA) -> int:
    """Deletes what `compact_upserted` has superseded and returns the number of folders; no reader may be on an older plan."""
    return (
        retire(spark, path, event_shape(schema), PARTITION_COLUMN)
        + retire(spark, tombstones_path(path), TOMBSTONE_SHAPE, PARTITION_COLUMN)
        + retire(spark, keys_path(path), KEY_SHAPE, KEY_RANGE)
    )


def unseen_stream(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return (
        events.writeStream.foreachBatch(append_unseen(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def upsert_stream(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return (
        events.writeStream.foreachBatch(upsert_days(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def country_counts(events: DataFrame, span: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Events per country and time window; a window is final once the watermark passes it."""
    timed = events.withWatermark(EVENT_TIME, delay).where(has_country())
    counts = timed.groupBy(F.window(EVENT_TIME, span), F.col("ActionGeo_CountryCode").alias("country_code"))
    return counts.agg(F.count("*").alias("event_count"), F.avg("AvgTone").alias("avg_tone")).select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "country_code",
        "event_count",
        "avg_tone",
    )


def spike_alerts(
    events: DataFrame,
    slide: str = "1 day",
    delay: str = "1 hour",
    min_ratio: float = 2.0,
    min_events: int = 10,
) -> DataFrame:
    """Countries whose last day in a sliding eight-day window reaches twice the mean before.

    Hourly counts come first, so that the sliding windows multiply hours and not events.
    """
    timed = events.withWatermark(EVENT_TIME, delay).where(has_country())
    hourly = timed.groupBy(
        F.window(EVENT_TIME, "1 hour"), F.col("ActionGeo_CountryCode").alias("country_code")
    ).agg(F.count("*").alias("n"))
    hourly = hourly.select(F.window_time("window").alias("hour"), "country_code", "n")
    sliding = hourly.groupBy(F.window("hour", "8 days", slide), "country_code")
    recent = F.col("hour") >= F.col("window.end") - F.expr("INTERVAL 24 HOURS")
    counts = sliding.agg(
        F.sum(F.when(recent, F.col("n")).otherwise(0)).alias("events_24h"),
        F.sum(F.when(~recent, F.col("n")).otherwise(0)).alias("earlier"),
    )
    baseline = F.col("earlier").cast("double") / 7.0
    times = F.col("events_24h") / baseline
    return counts.where(
        (F.col("earlier") > 0) & (F.col("events_24h") >= min_events) & (times >= min_ratio)
    ).select(
        F.col("window.end").alias("as_of"),
        "country_code",
        "events_24h",
        baseline.alias("baseline_avg"),
        times.alias("spike_ratio"),
    )


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write everything available to a Parquet folder, then stop."""
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
