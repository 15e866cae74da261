"""What the operators share: cut lineage, running sums and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from newsloom.session import ship_package, work_dir

#: Texts a task holds at once; a longer text is taken alone.
SLICE_BYTES = 8 << 20


def kept(rows: DataFrame) -> DataFrame:
    """Rows written once, as a table in the folder all executors share, and read from there without their lineage."""
    spark = rows.sparkSession
    folder = work_dir(spark, "kept")
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def in_tasks(rows: DataFrame, function: Callable, shape: T.StructType | str) -> DataFrame:
    """`function` over the Arrow batches of each partition, on executors that have this package."""
    ship_package(rows.sparkSession)
    return rows.mapInArrow(function, shape)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sliced(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the texts of `column` take about `limit` bytes each."""
    for batch in batches:
        lengths = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(lengths), 0).to_pylist()
        start = total = 0
        for at, size in enumerate(sizes):
            if at > start and total + size > limit:
                yield batch.slice(start, at - start)
                start, total = at, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """`rows` as a written table with a column `part`: ranges of `order`, numbered as the ranges follow each other."""
    return kept(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def earlier(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """`rows` with, for each name in `sums`, its sum over all rows before, by `part` and within a part by `order`.

    Rows meet by part only. Whole parts are added up first, one row each, and what the parts before them hold is summed at the
    driver: as many rows as there are parts, which are partitions of a shuffle, whatever the number of rows.
    """
    spark = rows.sparkSession
    totals = rows.groupBy("part").agg(*(F.sum(value).cast("bigint").alias(name) for name, value in sums.items())).collect()
    before, found = [0] * len(sums), []
    for row in sorted(totals, key=lambda row: row.part):
        found.append((row.part, *before))
        before = [known + (row[name] or 0) for known, name in zip(before, sums)]
    shape = ", ".join(["part int", *(f"{name}_before_part bigint" for name in sums)])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(spark.createDataFrame(found, shape), "part")
        .withColumns({
            name: F.col(f"{name}_before_part") + F.coalesce(F.sum(value).over(within), F.lit(0))
            for name, value in sums.items()
        })
        .drop(*(f"{name}_before_part" for name in sums))
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected `edges` (two columns of one orderable type).

    Returns (node, component), one row per node that has an edge to another node; the component
    is its smallest node. Edges with a NULL end and loops are ignored; no edges give no rows.
    Alternates large-star and small-star steps until every component is a star around its smallest
    node. Minima are combined before the shuffle, so a hub never meets in one task as a list, and
    the join that hands the minimum to a hub's edges is one that adaptive execution can split.
    """
    a, b = (F.col(name) for name in edges.columns)
    stars = kept(
        edges.select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst"))
        .where(a.isNotNull() & b.isNotNull() & (F.col("src") != F.col("dst")))
        .distinct()
    )
    while not _settled(stars):
        both = stars.union(stars.select("dst", "src"))
        lowest = both.groupBy("src").agg(F.min("dst").alias("low"))
        large = (
            both.join(lowest, "src")
            .where(F.col("dst") > F.col("src"))
            .select(F.col("dst").alias("src"), F.least("low", "src").alias("dst"))
            .distinct()
        )
        lowest = large.groupBy("src").agg(F.min("dst").alias("low"))
        rest = large.join(lowest, "src").where(F.col("dst") != F.col("low"))
        stars = kept(
            rest.select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            .union(lowest.select("src", F.col("low").alias("dst")))
            .distinct()
        )
    centres = stars.select("dst").distinct()
    return stars.toDF("node", "component").union(centres.select(F.col("dst"), F.col("dst")))


def _settled(stars: DataFrame) -> bool:
    """Whether every node points at one other, which points nowhere."""
    roles = stars.select(F.col("src").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("target")).union(
        stars.select("dst", F.lit(0), F.lit(1))
    )
    odd = (
        roles.groupBy("node")
        .agg(F.sum("points").alias("points"), F.max("target").alias("target"))
        .where(F.col("points") + F.col("target") > 1)
    )
    return odd.isEmpty()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
