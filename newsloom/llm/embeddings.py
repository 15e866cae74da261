"""Near-duplicate vectors by signs against random hyperplanes, in several tables, each candidate verified exactly.

Equal vectors are one class from the first shuffle on. In each table a class falls in the bucket its signs name; all pairs
of a bucket are compared in double precision, in blocks of bounded size. A pair that meets in several tables counts in the
first. Blocks report sums and a spanning forest, never their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.shared import components, in_tasks, kept

THRESHOLD = 0.9
#: Chance that a pair right at the threshold meets in some table; closer pairs have a higher one.
RECALL = 0.995
#: Classes a bucket should hold on average, and classes of one side of a block.
BUCKET, BLOCK = 256, 1024
SEED = 20_240_229


def tables_for(classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits per table, tables): buckets of about BUCKET classes, tables enough for the recall at the threshold."""
    bits = max(1, min(30, round(log2(max(2.0, classes / BUCKET)))))
    same = (1 - acos(threshold) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - same)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without NULLs, all lists of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _signed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """`classes` with `signs`, one bucket number per table."""
    weights = (1 << np.arange(bits)).astype(np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            found = np.zeros((batch.num_rows, tables), np.int64)
            for length in np.unique(lengths).tolist():
                if length not in planes:
                    planes = {length: np.random.default_rng((SEED, length)).standard_normal((length, tables * bits))}
                rows = np.flatnonzero(lengths == length)
                positive = _unit(_matrix(batch.column("vector").take(pa.array(rows)))) @ planes[length] > 0
                found[rows] = positive.reshape(len(rows), tables, bits) @ weights
            signs = pa.ListArray.from_arrays(np.arange(0, found.size + 1, tables, dtype=np.int32), found.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, signs], [*batch.schema.names, "signs"])

    return in_tasks(classes, sign, "first bigint, n bigint, length int, vector array<double>, signs array<bigint>")


def _compare(cell: pa.Table, threshold: float) -> pa.Table:
    """(first, links, low) of the classes of a block that link in it: rows they link to, and the smallest they reach."""
    table = cell.column("table")[0].as_py()
    crossing = cell.column("low")[0].as_py() != cell.column("high")[0].as_py()
    own = cell.column("own").to_numpy()
    first, count = cell.column("first").to_numpy(), cell.column("n").to_numpy()
    unit = _unit(_matrix(cell.column("vector").combine_chunks()))
    signs = cell.column("signs").combine_chunks().flatten().to_numpy().reshape(len(first), -1)[:, :table]
    a = np.flatnonzero(own == own.min()) if crossing else np.arange(len(first))
    b = np.flatnonzero(own != own.min()) if crossing else a
    links, low = np.zeros(len(first), np.int64), first.copy()
    near = unit[a] @ unit[b].T >= threshold
    if not crossing:
        np.fill_diagonal(near, False)
    new = near.copy()
    for at in range(table):
        new &= signs[a, at][:, None] != signs[b, at][None, :]
    links[a] += new @ count[b]
    if crossing:
        links[b] += new.T @ count[a]
    linked = np.zeros(len(first), bool)
    linked[a] = near.any(axis=1)
    linked[b] |= near.any(axis=0)
    top = np.iinfo(np.int64).max
    while linked.any():
        before = low.copy()
        low[a] = np.minimum(low[a], np.where(near, low[b][None, :], top).min(axis=1, initial=top))
        low[b] = np.minimum(low[b], np.where(near, low[a][:, None], top).min(axis=0, initial=top))
        if (before == low).all():
            break
    return pa.table({"first": first[linked], "links": links[linked], "low": low[linked]})


def near_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """One row (id, n_links, component_id, kept) per row of `vectors`; ids are integers and may repeat, with one vector or several.

    Rows link where the cosine of their vectors, in double precision, is `threshold` or more and they are equal or meet in
    a table. Vectors that are NULL, empty, zero or hold a NULL or non-finite component, vectors of different lengths and
    rows without an id link with nothing: n_links 0, their own id as component. Repeated rows link with each other; rows that
    share an id with different vectors are judged each by its own. component_id is the smallest id of the rows reached. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("vector")
    )
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("id").isNotNull() & ~odd & F.exists("vector", lambda x: x != 0)
    sound = rows.where(usable)
    # Classes have numbers of their own, since rows may share an id; `lowest` is their smallest id.
    classes = kept(
        sound.groupBy("vector")
        .agg(F.min("id").alias("lowest"), F.count("*").alias("n"))
        .select(F.monotonically_increasing_id().alias("first"), "n", F.size("vector").alias("length"), "vector", "lowest")
    )
    bits, tables = tables_for(classes.count(), threshold, recall)
    placed = _signed(classes.drop("lowest"), bits, tables).select("*", F.posexplode("signs").alias("table", "bucket"))
    key = ["length", "table", "bucket"]
    sizes = placed.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where(F.col("blocks") > 1)
    spread = (
        placed.join(sizes, key, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("first"), "blocks"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
        .select(*key, "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "first", "n", "vector", "signs")
    )
    found = kept(
        spread.groupBy(*key, "low", "high").applyInArrow(
            lambda cell: _compare(cell, threshold), "first bigint, links bigint, low bigint"
        )
    )
    degree = found.groupBy("first").agg(F.sum("links").alias("links"))
    joined = components(found.where(F.col("first") != F.col("low")).select("first", "low"))
    placed_in = kept(
        classes.select("vector", "first", "n", "lowest")
        .join(degree, "first", "left")
        .join(joined.withColumnRenamed("node", "first"), "first", "left")
        .select(
            "vector",
            "lowest",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "first").alias("component"),
        )
    )
    smallest = placed_in.groupBy("component").agg(F.min("lowest").alias("component_id"))
    named = placed_in.join(smallest, "component").select("vector", "n_links", "component_id")
    linked = sound.join(named, "vector").select("id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("id", F.lit(0).cast("bigint"), "id")
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
