"""The stored event table, the realtime buffer and result caches."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from newsloom.functions.dates import day_number, number_day_col
from newsloom.plans.enrichment import drop_days, enrich_batch
from newsloom.schema import ENRICHED_SCHEMA, PARTITION_COLUMN, RAW_EVENT_COLUMNS
from newsloom.sources.batches import is_table, remove
from newsloom.sources.landed import conform


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Enriched events below a folder, in the fixed column order.

    Fails if the folder is missing or holds no Parquet file. Columns that older files
    lack are NULL. A table written by `write_days` also has its partition column.
    """
    found = spark.read.parquet(path)
    keep = [PARTITION_COLUMN] if PARTITION_COLUMN in found.columns else []
    events = conform(found, ENRICHED_SCHEMA, *keep)
    return events.select(*ENRICHED_SCHEMA.fieldNames(), *keep)


def one_day(events: DataFrame, day: date) -> DataFrame:
    """Raw event columns of one day; prunes to its partition."""
    rows = events.where(F.col("SQLDATE") == day_number(day))
    if PARTITION_COLUMN in events.columns:
        rows = rows.where(F.col(PARTITION_COLUMN) == F.lit(day))
    return rows.select(RAW_EVENT_COLUMNS)


def write_days(events: DataFrame, path: str) -> None:
    """Replace the days that occur in `events`, keep all others.

    Rows whose SQLDATE is no day have no day to replace. They are added to a table beside this
    one, see `read_undated`, and never replace each other. Rebalancing gives evenly sized files whatever the size of a day; rows are sorted by
    country so that a country filter skips row groups.
    """
    marked = events.withColumn(PARTITION_COLUMN, number_day_col(F.col("SQLDATE")))
    dated = marked.where(F.col(PARTITION_COLUMN).isNotNull())
    add_undated(marked, path)
    (
        dated.hint("rebalance", F.col(PARTITION_COLUMN))
        .sortWithinPartitions(PARTITION_COLUMN, "ActionGeo_CountryCode")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PARTITION_COLUMN)
        .parquet(path)
    )


def undated_path(path: str) -> str:
    return f"{path.rstrip('/')}_undated"


def add_undated(rows: DataFrame, path: str) -> None:
    """Adds the rows without a day to the table beside `path`."""
    undated = rows.where(F.col(PARTITION_COLUMN).isNull()).drop(PARTITION_COLUMN)
    if not undated.isEmpty():
        undated.write.mode("append").parquet(undated_path(path))


def read_undated(spark: SparkSession, path: str, schema: StructType = ENRICHED_SCHEMA) -> DataFrame:
    """Rows that came without a valid day, equal ones once, as a run that was repeated adds them again."""
    if not is_table(spark, undated_path(path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(undated_path(path)).distinct()


def backfill_days(today: date, days: int, start_offset: int = 1) -> list[date]:
    """The last `days` days, oldest first, ending `start_offset` days ago."""
    return [today - timedelta(days=ago) for ago in range(start_offset + days - 1, start_offset - 1, -1)]


def ingest_days(
    events: DataFrame, mentions: DataFrame, documents: DataFrame, days: list[date], path: str
) -> None:
    """Enrich and store a range of days as one job. Days without rows are left alone."""
    wanted = F.col(PARTITION_COLUMN).isin(days)
    enriched = enrich_batch(
        events.where(wanted), mentions.where(wanted), documents.where(wanted), day=PARTITION_COLUMN
    )
    write_days(enriched.drop(PARTITION_COLUMN), path)


def with_buffer(stored: DataFrame, buffer: DataFrame) -> DataFrame:
    """Stored days plus the buffered days that are not stored yet."""
    return stored.unionByName(drop_days(buffer, stored), allowMissingColumns=True)


def retire_buffer(spark: SparkSession, buffer_path: str, stored: DataFrame) -> list[date]:
    """Deletes the days of a buffer that are stored by now; returns them, oldest first.

    The buffer is partitioned by day, as `write_days` leaves it, and a day goes as a whole, so a stop in between leaves
    days for the next run. Readers of `with_buffer` see the same rows before and after. Rows that landed for a stored day
    go with it: the daily form of a day replaces its quarter hours. A missing buffer has no days.
    """
    if not is_table(spark, buffer_path):
        return []
    held = spark.read.parquet(buffer_path).select(PARTITION_COLUMN).distinct()
    days = held.join(stored.select(PARTITION_COLUMN).distinct(), PARTITION_COLUMN, "left_semi")
    found = sorted(row[0] for row in days.collect())
    for day in found:
        remove(spark, f"{buffer_path.rstrip('/')}/{PARTITION_COLUMN}={day}")
    return found


# --- caches ---------------------------------------------------------------------


def write_cache(rows: DataFrame, path: str, form: str = "parquet") -> None:
    rows.write.mode("overwrite").format(form).save(path)


def read_cache(spark: SparkSession, path: str, schema: StructType, form: str = "parquet") -> DataFrame:
    """A cached result; an empty one if it is missing or has another shape."""
    try:
        found = spark.read.format(form).load(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    if not set(schema.fieldNames()) <= set(found.columns):
        return spark.createDataFrame([], schema)
    return found.select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])
