"""Country lookups: reading, preference order and name joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.functions.text import strip


def parse_lookup(lines: DataFrame) -> DataFrame:
    """`CODE<TAB>NAME` lines (column `value`) to (code, name).

    A heading that starts with CODE, blank lines and lines without a name are dropped;
    a code given twice keeps its alphabetically last name.
    """
    text = lines.select(strip(F.col("value")).alias("line"))
    parts = F.split("line", "\t", 2)
    rows = text.where(F.size(parts) == 2).select(
        F.upper(strip(parts[0])).alias("code"), strip(parts[1]).alias("name")
    )
    heading = F.col("code") == "CODE"
    rows = rows.where((F.col("code") != "") & (F.col("name") != "") & ~heading)
    return rows.groupBy("code").agg(F.max("name").alias("name"))


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    return parse_lookup(spark.read.text(path))


def prefer(*lookups: DataFrame) -> DataFrame:
    """The first lookup that has rows, decided inside the plan."""
    ranked = None
    for rank, lookup in enumerate(lookups):
        part = lookup.select("code", "name", F.lit(rank).alias("rank"))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.agg(F.min("rank").alias("rank")).scalar()
    return ranked.where(F.col("rank") == best).select("code", "name")


def with_country_names(rows: DataFrame, names: DataFrame, code: str, prefix: str) -> DataFrame:
    """Adds `<prefix>_name` (NULL if unknown) and `<prefix>_display`, 'Name (CODE)'.

    The lookup is joined without a hint: Spark broadcasts it below the size threshold
    and shuffles it above.
    """
    key, name = f"{prefix}_lookup_code", f"{prefix}_name"
    lookup = names.select(F.col("code").alias(key), F.col("name").alias(name))
    joined = rows.join(lookup, F.col(code) == F.col(key), "left").drop(key)
    display = (
        F.when(F.coalesce(F.col(code), F.lit("")) == "", "Unknown")
        .when(F.col(name).isNull(), F.col(code))
        .otherwise(F.concat(name, F.lit(" ("), F.col(code), F.lit(")")))
    )
    return joined.withColumn(f"{prefix}_display", display)
