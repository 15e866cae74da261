"""Backfills that outlive a bad day, with a ledger of what became of each.

The ledger is a table beside the stored one, one row per day and attempt. A day counts as stored once its ledger row is
there, which is written after its partition; a run that stops in between stores the day again, whole, and ends the same.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.functions.dates import number_day_col
from newsloom.plans.enrichment import ID
from newsloom.schema import PARTITION_COLUMN
from newsloom.sources.batches import is_table
from newsloom.sources.store import ingest_days, read_events, retire_buffer

STORED, FAILED, EMPTY = "stored", "failed", "empty"
LEDGER = f"{PARTITION_COLUMN} date, attempt int, state string, rows bigint, files bigint, bytes bigint, problem string"
#: Characters of an error that the ledger keeps.
PROBLEM_LENGTH = 300


def default_checks() -> dict[str, Column]:
    """What makes an event row unfit, and with it its day: text of the problem and whether a row has it."""
    day = number_day_col(F.col("SQLDATE").try_cast("int"))
    return {
        "event without a numeric id": F.col(ID).try_cast("bigint").isNull(),
        "event of another day": ~day.eqNullSafe(F.col(PARTITION_COLUMN)),
    }


def ledger_path(path: str) -> str:
    return f"{path.rstrip('/')}_ledger"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Every attempt at every day of the table at `path`."""
    if not is_table(spark, ledger_path(path)):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger_path(path))


def day_states(ledger: DataFrame) -> DataFrame:
    """The last attempt at each day, one row per day."""
    newest = F.max_by(F.struct("attempt", "state", "rows", "files", "bytes", "problem"), "attempt").alias("last")
    return ledger.groupBy(PARTITION_COLUMN).agg(newest).select(PARTITION_COLUMN, "last.*")


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of every Parquet file below a folder, also of those without rows; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return found.select("path", F.col("length").alias("bytes"))


def _stored(frames: tuple[DataFrame, DataFrame, DataFrame], days: list[date], path: str) -> dict[date, str | None]:
    """Stores `days` in one job, or where that fails in halves, so that a day that breaks it is left alone; problem per day."""
    if not days:
        return {}
    try:
        ingest_days(*frames, days, path)
    except AnalysisException:
        # The plan itself is wrong, whatever the day.
        raise
    except (Py4JJavaError, PySparkException) as error:
        if len(days) == 1:
            return {days[0]: " ".join(str(error).split())[:PROBLEM_LENGTH]}
        half = len(days) // 2
        return _stored(frames, days[:half], path) | _stored(frames, days[half:], path)
    return dict.fromkeys(days)


def backfill(
    events: DataFrame, mentions: DataFrame, documents: DataFrame, days: list[date], path: str,
    checks: Mapping[str, Column] | None = None, buffer_path: str | None = None,
) -> DataFrame:
    """Enriches and stores those of `days` that the ledger does not have as stored; returns the ledger rows of this run.

    All three tables carry the day column. One scan of the events counts rows and problems of each pending day; a day with a
    problem is reported and not stored, one without rows is `empty` and left alone. The other days are stored as one job. If
    that fails in a task, it is run in halves until the failing days are alone; they are reported with the error and all others
    are stored. Reported and empty days are tried again by the next call. With `buffer_path`, stored days leave the buffer.
    What reaches the driver are a few figures a day.
    """
    spark = events.sparkSession
    checks = default_checks() if checks is None else checks
    known = {row[PARTITION_COLUMN]: row for row in day_states(read_ledger(spark, path)).where(F.col(PARTITION_COLUMN).isin(days)).collect()} if days else {}
    pending = [day for day in sorted(set(days)) if day not in known or known[day].state != STORED]
    found: dict[date, tuple[int, str | None]] = {}
    readable, unread = _counted(events, pending, checks)
    found.update(readable)
    fit = [day for day in pending if found.get(day, (0, None))[0] and found[day][1] is None]
    outcome = _stored((events, mentions, documents), fit, path)
    sizes = _sizes(spark, path) if any(problem is None for problem in outcome.values()) else {}
    rows = []
    for day in pending:
        attempt = known[day].attempt + 1 if day in known else 1
        count, problem = found.get(day, (0, None))
        problem = unread.get(day) or problem or outcome.get(day)
        if problem is not None:
            rows.append((day, attempt, FAILED, None, None, None, problem))
        elif not count:
            rows.append((day, attempt, EMPTY, 0, None, None, None))
        else:
            rows.append((day, attempt, STORED, count, *sizes.get(day, (0, 0)), None))
    run = spark.createDataFrame(rows, LEDGER)
    if rows:
        run.coalesce(1).write.mode("append").parquet(ledger_path(path))
    if buffer_path is not None and is_table(spark, path):
        retire_buffer(spark, buffer_path, read_events(spark, path))
    return run


def _counted(
    events: DataFrame, days: list[date], checks: Mapping[str, Column]
) -> tuple[dict[date, tuple[int, str | None]], dict[date, str]]:
    """Rows and first problem of each day that can be read, and the error of each that cannot."""
    if not days:
        return {}, {}
    texts = list(checks)
    figures = [F.count_if(checks[text]).alias(f"p{at}") for at, text in enumerate(texts)]
    counted = events.where(F.col(PARTITION_COLUMN).isin(days)).groupBy(PARTITION_COLUMN).agg(F.count("*").alias("n"), *figures)
    try:
        rows = counted.collect()
    except AnalysisException:
        raise
    except (Py4JJavaError, PySparkException) as error:
        if len(days) == 1:
            return {}, {days[0]: " ".join(str(error).split())[:PROBLEM_LENGTH]}
        half = len(days) // 2
        first, second = _counted(events, days[:half], checks), _counted(events, days[half:], checks)
        return first[0] | second[0], first[1] | second[1]
    found = {}
    for row in rows:
        bad = [f"{text}: {row[f'p{at}']} rows" for at, text in enumerate(texts) if row[f"p{at}"]]
        found[row[PARTITION_COLUMN]] = (row.n, "; ".join(bad) or None)
    return found, {}


def _sizes(spark: SparkSession, path: str) -> dict[date, tuple[int, int]]:
    """Files and bytes per stored day."""
    day = F.to_date(F.regexp_extract("path", f"{PARTITION_COLUMN}=([0-9-]+)", 1))
    rows = stored_files(spark, path).groupBy(day.alias("day")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return {row.day: (row.files, row.bytes) for row in rows.collect()}
