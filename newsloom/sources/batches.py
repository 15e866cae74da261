"""Tables that grow by numbered batches, and their compaction behind the readers.

A table is partitioned by one column (`part`, a day or a range of ids) and by the number of the batch that added the rows:

    <folder>/<part>=v/ingest_seq=n         rows that batch n added to v
    <folder>_bases/<part>=v/upto=n         rows of v through batch n, merged
    <folder>_merged                        (part, upto) of the bases that are complete

A batch replaces nothing but its own files. Readers take a partition's newest complete base and the batches after it, so
a merge may stop anywhere: what is not complete is not seen, and what is superseded is not read even if it is still there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

SEQUENCE = "ingest_seq"
UPTO = "upto"
#: Rows of a partition that a merge puts into one slice, hashed by key, and the column that numbers the slices.
SLICE_ROWS, SLICE = 1 << 18, "merge_slice"


def is_table(spark: SparkSession, path: str) -> bool:
    """Whether there is a table; only a missing path or an empty folder says no, any other failure is raised."""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def _found(spark: SparkSession, paths: str, shape: StructType, below: str | None = None) -> DataFrame | None:
    """The files of a table in a known shape, which needs no look into them; None if there is no such path."""
    reader = spark.read.schema(shape)
    try:
        return (reader.option("basePath", below) if below else reader).parquet(paths)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _rows(spark: SparkSession, paths: str, shape: StructType, below: str | None = None) -> DataFrame:
    found = _found(spark, paths, shape, below)
    return spark.createDataFrame([], shape) if found is None else found


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever store it is; a missing one is left alone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bases_path(folder: str) -> str:
    return f"{folder.rstrip('/')}_bases"


def merged_path(folder: str) -> str:
    return f"{folder.rstrip('/')}_merged"


def commits_path(folder: str) -> str:
    return f"{folder.rstrip('/')}_commits"


def _put(rows: DataFrame, folder: str, *parts: str) -> None:
    """Writes `rows` as they lie in place of the partitions they fall in; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(folder)


def _replace(rows: DataFrame, folder: str, *parts: str) -> None:
    """The same, rebalanced into files of even size."""
    _put(rows.hint("rebalance", F.col(parts[0])), folder, *parts)


def write_batch(rows: DataFrame, folder: str, part: str, number: int) -> None:
    """Adds `rows` as batch `number`; the same batch written again takes the place of its first form."""
    _replace(rows.withColumn(SEQUENCE, F.lit(number).cast("bigint")), folder, part, SEQUENCE)


def read_batch(spark: SparkSession, folder: str, shape: StructType, part: str, number: int) -> DataFrame:
    """Rows that batch `number` added, committed or not; only its folders are listed. A batch without rows is empty."""
    return _rows(spark, f"{folder.rstrip('/')}/{part}=*/{SEQUENCE}={number}", shape, folder)


def commit(spark: SparkSession, folder: str, number: int) -> None:
    """Makes the batches up to `number` visible to readers that ask for `committed` ones."""
    _replace(spark.range(1).withColumn(SEQUENCE, F.lit(number).cast("bigint")), commits_path(folder), SEQUENCE)


def committed(spark: SparkSession, folder: str) -> int | None:
    """Number of the last committed batch; None if there is none."""
    done = _rows(spark, commits_path(folder), StructType([StructField(SEQUENCE, LongType())]))
    return done.agg(F.max(SEQUENCE)).first()[0]


def _newest_bases(spark: SparkSession, folder: str, part: StructField) -> DataFrame | None:
    """(part, upto) of each merged partition, one row each."""
    done = _found(spark, merged_path(folder), StructType([part, StructField(UPTO, LongType())]))
    return None if done is None else done.groupBy(part.name).agg(F.max(UPTO).alias(UPTO))


def read_batches(spark: SparkSession, folder: str, shape: StructType, part: str, last: int | None = None) -> DataFrame:
    """All rows of the table through batch `last`, in the columns of `shape`, which end with `part` and the batch number.

    A merged partition comes from its base and the batches after it. A filter on `part` prunes both. A missing table is empty.
    """
    rows = _rows(spark, folder, shape)
    if last is not None:
        rows = rows.where(F.col(SEQUENCE) <= last)
    newest = _newest_bases(spark, folder, shape[part])
    if newest is None:
        return rows
    later = rows.join(newest, part, "left").where(F.col(UPTO).isNull() | (F.col(SEQUENCE) > F.col(UPTO)))
    base = spark.read.schema(StructType([*shape.fields, StructField(UPTO, LongType())])).parquet(bases_path(folder))
    names = shape.fieldNames()
    return later.select(names).union(base.join(newest, [part, UPTO]).select(names))


def merge_batches(
    spark: SparkSession, folder: str, shape: StructType, part: str, key: str, merge: Callable[[DataFrame, tuple[str, ...]], DataFrame],
    last: int | None = None, batches: int = 2, beside: DataFrame | None = None,
) -> None:
    """Writes new bases for the partitions that at least `batches` batches have added to since their last one.

    `merge` maps a partition's rows, and those of `beside` that fall in it, to the rows that readers need, all partitions at
    once. Rows move once: those of a partition and `key` lie in one slice, slices have about SLICE_ROWS rows, and `merge` is told
    the columns (partition, number of the base, slice) that it should group by, before the key, and keep. They are written from where they lie.
    Bases get names of their own and count once they are listed as complete, after they are written.
    """
    if not is_table(spark, folder):
        return
    rows = read_batches(spark, folder, shape, part, last)
    added = spark.read.schema(shape).parquet(folder)
    if last is not None:
        added = added.where(F.col(SEQUENCE) <= last)
    added = added.groupBy(part).agg(F.max(SEQUENCE).alias("newest"))
    newest = _newest_bases(spark, folder, shape[part])
    slices = F.ceil(F.count("*") / SLICE_ROWS).alias("slices")
    open_batches = rows.groupBy(part).agg(F.count_distinct(SEQUENCE).alias("n"), slices).join(added, part)
    if newest is not None:
        open_batches = open_batches.join(newest, part, "left").where(F.col(UPTO).isNull() | (F.col("newest") > F.col(UPTO))).drop(UPTO)
    chosen = open_batches.where(F.col("n") >= batches).select(part, F.col("newest").alias(UPTO), "slices").persist()
    try:
        if chosen.isEmpty():
            return
        rows = rows if beside is None else rows.unionByName(beside, allowMissingColumns=True)
        layout = (part, UPTO, SLICE)
        sliced = rows.join(F.broadcast(chosen), part).withColumn(SLICE, F.pmod(F.xxhash64(key), "slices")).drop("slices")
        _put(merge(sliced.repartition(*layout), layout).drop(SLICE), bases_path(folder), part, UPTO)
        chosen.select(part, UPTO).coalesce(1).write.mode("append").parquet(merged_path(folder))
    finally:
        chosen.unpersist()


def retire(spark: SparkSession, folder: str, shape: StructType, part: str) -> int:
    """Deletes the batches and bases that complete bases supersede; returns how many folders went.

    Only run it when no reader is still on a plan from before the merge. Whole partitions go, one after the other; a stop in
    between leaves some for the next run, and readers see the same rows at any time.
    """
    newest = _newest_bases(spark, folder, shape[part])
    if newest is None:
        return 0
    name = F.col(part).cast("string")
    old = [
        spark.read.schema(shape).parquet(folder).select(part, SEQUENCE).distinct().join(newest, part)
        .where(F.col(SEQUENCE) <= F.col(UPTO))
        .select(F.format_string(f"%s/{part}=%s/{SEQUENCE}=%s", F.lit(folder.rstrip("/")), name, F.col(SEQUENCE).cast("string")))
    ] if is_table(spark, folder) else []
    stored = spark.read.schema(StructType([shape[part], StructField(UPTO, LongType())])).parquet(bases_path(folder))
    old.append(
        stored.select(part, F.col(UPTO).alias("own")).distinct().join(newest, part).where(F.col("own") < F.col(UPTO))
        .select(F.format_string(f"%s/{part}=%s/{UPTO}=%s", F.lit(bases_path(folder)), name, F.col("own").cast("string")))
    )
    folders = [row[0] for frame in old for row in frame.toLocalIterator()]
    for place in folders:
        remove(spark, place)
    return len(folders)
