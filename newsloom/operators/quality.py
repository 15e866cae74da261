"""Storage metrics and the data quality funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.dates import number_day_col


def _one_form(path: Column) -> Column:
    """A file's path with one slash behind its scheme and nothing escaped, as listings and scans write it differently."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(plain, "^([A-Za-z0-9]+):/+", "$1:/")


def storage_metrics(stored: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Files, files without rows, bytes, rows, day range and averages of a stored table.

    `stored` must come straight from a file source; of it the day is read. A scan does not see files without
    rows: `listed` (path, bytes) names all files, see `backfill.stored_files`, which opens none of them.
    """
    files = stored.groupBy(_one_form(F.col("_metadata.file_path")).alias("path")).agg(
        F.max("_metadata.file_size").alias("bytes"),
        F.count("*").alias("n"),
        F.min("SQLDATE").alias("oldest"),
        F.max("SQLDATE").alias("newest"),
    )
    if listed is not None:
        every = listed.select(_one_form(F.col("path")).alias("path"), "bytes")
        files = every.join(files.drop("bytes"), "path", "left")
    total = files.agg(
        F.count("*").alias("files"),
        F.count_if(F.coalesce("n", F.lit(0)) == 0).alias("empty_files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.min("oldest").alias("oldest_sqldate"),
        F.max("newest").alias("newest_sqldate"),
    )
    return _averages(total).withColumn(
        "bytes_per_row",
        F.when(F.col("total_rows") > 0, F.round(F.col("total_bytes") / F.col("total_rows"), 1)).otherwise(
            F.lit(0.0)
        ),
    )


def row_volume(events: DataFrame) -> DataFrame:
    """Rows, day range and rows per day of any event table."""
    total = events.agg(
        F.count("*").alias("total_rows"),
        F.min("SQLDATE").alias("oldest_sqldate"),
        F.max("SQLDATE").alias("newest_sqldate"),
    )
    return _averages(total)


def _averages(total: DataFrame) -> DataFrame:
    span = F.datediff(number_day_col(F.col("newest_sqldate")), number_day_col(F.col("oldest_sqldate")))
    days = F.greatest(F.lit(1), span)
    return total.withColumn("days_of_data", F.when(span.isNotNull(), days)).withColumn(
        "rows_per_day", F.round(F.col("total_rows") / F.col("days_of_data"), 0).cast("bigint")
    )


REQUIRED = ("GLOBALEVENTID", "SQLDATE", "EventRootCode", "GoldsteinScale", "NumMentions")
MIN_MENTIONS = 3


def _greatest_copy(rows: DataFrame) -> DataFrame:
    """One row per event, of copies the greatest by the required columns; `copies` counts them. Combined before the shuffle."""
    rest = [c for c in rows.columns if c not in REQUIRED]
    # Lists compare, maps would not; the required columns come first and decide.
    kept = F.max(F.struct(*REQUIRED[1:], *rest)).alias("kept")
    return rows.groupBy("GLOBALEVENTID").agg(F.count("*").alias("copies"), kept).select("GLOBALEVENTID", "copies", "kept.*")


def _steps() -> dict[str, Column]:
    """Conditions of the cleaning steps, each with those before it. A value that does not cast counts as missing."""
    types = {"GLOBALEVENTID": "bigint", "SQLDATE": "int", "EventRootCode": "string",
             "GoldsteinScale": "double", "NumMentions": "bigint"}
    present, typed = F.lit(True), F.lit(True)
    for name, kind in types.items():
        present &= F.col(name).isNotNull()
        typed &= F.col(name).try_cast(kind).isNotNull()
    mentioned = present & typed & (F.col("NumMentions").try_cast("bigint") >= MIN_MENTIONS)
    sound = mentioned & F.col("GoldsteinScale").try_cast("double").between(-10, 10)
    return {"complete": present, "typed": present & typed, "mentioned": mentioned, "kept": sound}


def clean_events(events: DataFrame) -> DataFrame:
    """One row per event, nothing required missing, mentioned enough, Goldstein in range: the rows `quality_funnel` counts as kept."""
    return _greatest_copy(events).where(_steps()["kept"]).select(events.columns)


def quality_funnel(rows: DataFrame) -> DataFrame:
    """Row counts before and after each cleaning step, from one pass over the rows.

    Columns may still be strings: a value that does not cast counts as missing.
    """
    events = _greatest_copy(rows.select(*REQUIRED))
    return events.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("raw_rows"),
        F.count("*").alias("distinct_events"),
        *(F.count_if(step).alias(name) for name, step in _steps().items()),
    )
