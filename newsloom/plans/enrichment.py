"""Events joined with their mentions and the entity lists of their articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.functions.text import entity_list
from newsloom.schema import ENRICHED_SCHEMA, LIST_COLUMNS, PARTITION_COLUMN
from newsloom.sources.landed import conform

ID = "GLOBALEVENTID"
DOCUMENT_LISTS = ("Themes", "Persons", "Organizations")


def mention_stats(mentions: DataFrame, *keys: str) -> DataFrame:
    """Mentions and mean confidence per event."""
    return mentions.groupBy(ID, *keys).agg(
        F.count("*").alias("mentions_count"),
        F.avg(F.col("Confidence").try_cast("double")).alias("avg_confidence"),
    )


def first_mentions(mentions: DataFrame, order: Column | None = None) -> DataFrame:
    """`mention_stats` plus the URL of the first mention by `order` (default: by URL)."""
    order = F.col("MentionIdentifier") if order is None else order
    return mentions.groupBy(ID).agg(
        F.count("*").alias("mentions_count"),
        F.avg(F.col("Confidence").try_cast("double")).alias("avg_confidence"),
        F.min_by("MentionIdentifier", order).alias("top_mention_url"),
    )


def one_per_document(documents: DataFrame, *keys: str) -> DataFrame:
    """One row of delimited lists per document, so that the join cannot multiply events.

    Each list joins those of all the document's rows, equal ones once; NULL only if all are.
    The sets combine before the shuffle, however often one document occurs.
    """
    joined = [F.array_join(F.array_sort(F.collect_set(name)), ";") for name in DOCUMENT_LISTS]
    lists = [F.when(F.max(F.col(name).isNotNull()), value).alias(name) for name, value in zip(DOCUMENT_LISTS, joined)]
    return documents.groupBy("DocumentIdentifier", *keys).agg(*lists)


def fullest_row(documents: DataFrame, *keys: str) -> DataFrame:
    """The document's row with the fewest NULL lists, of several the smallest; lists keep their repeats and order."""
    missing = sum((F.col(name).isNull().cast("int") for name in DOCUMENT_LISTS), F.lit(0))
    lists = F.min(F.struct(missing.alias("missing"), *DOCUMENT_LISTS)).alias("lists")
    named = [F.col(f"lists.{name}") for name in DOCUMENT_LISTS]
    return documents.groupBy("DocumentIdentifier", *keys).agg(lists).select("DocumentIdentifier", *keys, *named)


def _with_lists(
    events: DataFrame, documents: DataFrame, url: str, distinct: bool, keys: tuple[str, ...]
) -> DataFrame:
    """Adds the entity lists of the document at column `url`.

    Events without a URL get a key of their own, so they do not meet in one partition;
    a hot URL is split by the adaptive skew join, its document being a single row. The
    strings are cut into lists after the join, once the shuffle is behind.
    """
    merge = one_per_document if distinct else fullest_row
    lists = merge(documents.where(F.col("DocumentIdentifier").isNotNull()), *keys)
    own = F.concat(F.lit("#"), F.col(ID).cast("string"))
    keyed = events.withColumn("DocumentIdentifier", F.coalesce(F.col(url), own))
    joined = keyed.join(lists, ["DocumentIdentifier", *keys], "left")
    return joined.withColumns(
        {
            name: entity_list(F.col(name.capitalize()), distinct)
            for name in LIST_COLUMNS
        }
    )


def enrich_batch(
    events: DataFrame,
    mentions: DataFrame,
    documents: DataFrame,
    day: str | None = None,
    distinct: bool = True,
) -> DataFrame:
    """Daily form: the lists come from the document at the event's own URL.

    `day` names a day column all three have. Events then meet only mentions and
    documents of their day, so that one job covers a range of days.
    """
    keys = (day,) if day else ()
    rows = events.join(mention_stats(mentions, *keys), [ID, *keys], "left")
    rows = _with_lists(rows, documents, "SOURCEURL", distinct, keys)
    rows = rows.withColumn("mentions_count", F.coalesce("mentions_count", F.lit(0)))
    return conform(rows, ENRICHED_SCHEMA, *keys)


def enrich_stream(
    events: DataFrame,
    mentions: DataFrame,
    documents: DataFrame,
    order: Column | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Quarter-hour form: the lists come from the document of the first mention."""
    rows = events.join(first_mentions(mentions, order), ID, "left")
    return conform(_with_lists(rows, documents, "top_mention_url", distinct, ()))


# --- keeping one row per event --------------------------------------------------


def newest_ids(events: DataFrame, rows: int | None = None) -> DataFrame:
    """Known ids; with `rows` only those of that many newest rows, so that an older repeat is not recognised."""
    known = events.where(F.col(ID).isNotNull()).select(ID, "SQLDATE")
    return (known if rows is None else known.orderBy(F.desc("SQLDATE"), F.desc(ID)).limit(rows)).select(ID)


def drop_known(incoming: DataFrame, known: DataFrame) -> DataFrame:
    return incoming.join(known, ID, "left_anti")


def keep_last(rows: DataFrame, *order: Column, key: str | Sequence[str] = ID) -> DataFrame:
    """The last row per key (one column or several) by `order`.

    Spark cuts each map task's rows to one per key before the shuffle, so a key with
    very many copies does not load one task.
    """
    newest = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*(column.desc() for column in order))
    return rows.withColumn("newest", F.row_number().over(newest)).where("newest = 1").drop("newest")


def drop_days(buffer: DataFrame, written: DataFrame) -> DataFrame:
    """Buffer rows of days the daily table does not have yet.

    Where both have the partition column, the written days come from it and no data page
    of the daily table is read.
    """
    both = PARTITION_COLUMN in buffer.columns and PARTITION_COLUMN in written.columns
    day = PARTITION_COLUMN if both else "SQLDATE"
    return buffer.join(written.select(day).distinct(), day, "left_anti")
