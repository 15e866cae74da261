"""Landed feed files: manifests, positional fields, schema conforming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from newsloom.functions.text import strip
from newsloom.schema import (
    ENRICHED_SCHEMA,
    ENTITY_POSITIONS,
    EVENT_POSITIONS,
    LIST_COLUMNS,
    MENTION_POSITIONS,
)


def manifest_files(lines: DataFrame, *keep: str) -> DataFrame:
    """`size hash url` lines (column `value`) to (kind, url); other lines are dropped."""
    line = strip(F.col("value"))
    # What a line of each feed contains.
    kind = (
        F.when(line.contains("export.CSV"), "events")
        .when(line.contains("mentions.CSV"), "mentions")
        .when(F.lower(line).contains("gkg.csv"), "entities")
    )
    url = F.element_at(F.split(line, r"\s+"), -1)
    files = lines.select(kind.alias("kind"), url.alias("url"), *keep)
    return files.where(F.col("kind").isNotNull())


def manifest_urls(lines: DataFrame, order: str) -> DataFrame:
    """One URL per kind: that of the last line by the `order` column."""
    files = manifest_files(lines, order)
    return files.groupBy("kind").agg(F.max_by("url", order).alias("url"))


def project_fields(lines: DataFrame, positions: dict[str, int], *keep: str) -> DataFrame:
    """Tab-separated lines (column `value`) to named strings.

    A position past the end of a line gives NULL, and so does an empty field.
    """
    fields = F.split("value", "\t", -1)
    return lines.select(
        *keep,
        *(F.nullif(F.get(fields, F.lit(at)), F.lit("")).alias(name) for name, at in positions.items()),
    )


def conform(rows: DataFrame, schema: StructType = ENRICHED_SCHEMA, *keep: str) -> DataFrame:
    """Exactly the columns of the schema, in order: missing ones NULL, bad values NULL."""

    def fitted(field) -> Column:
        if field.name not in rows.columns:
            value = F.lit(None).cast(field.dataType)
        elif rows.schema[field.name].dataType == field.dataType:
            value = F.col(field.name)
        else:
            value = F.col(field.name).try_cast(field.dataType)
        if field.name in LIST_COLUMNS:
            value = F.coalesce(value, F.array().cast(field.dataType))
        return value.alias(field.name)

    return rows.select(*keep, *(fitted(field) for field in schema))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files (also .gz), with the file a line came from for later ordering."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("landed_file"))


def landed_events(lines: DataFrame, positions: dict[str, int] = EVENT_POSITIONS) -> DataFrame:
    """Event lines as strings; the index map is an argument, two layouts are in use."""
    return project_fields(lines, positions)


def landed_mentions(lines: DataFrame, positions: dict[str, int] = MENTION_POSITIONS) -> DataFrame:
    return project_fields(lines, positions)


def landed_entities(lines: DataFrame, positions: dict[str, int] = ENTITY_POSITIONS) -> DataFrame:
    return project_fields(lines, positions)
