"""A mix of sources to target weights, in the order of a curriculum that changes over training time.

Each source has a demand for words (its target) and a schedule, the shape of that demand over training time 0 to 1. Its
documents, in the order of a hash, meet the demand one after another, again from the start when they run out. A
document's place in the cumulative demand, inverted through the integral of the schedule, is its training position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.llm.shared import earlier, kept, ranged

#: Weights of the sources in code-point order, repeating, and how often a source may be repeated.
WEIGHTS, MOST = (5, 2, 1), 3
#: Schedules, one per weight: (training time, relative rate), linear in between. Heavy sources fade, light ones grow.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))

Schedule = Sequence[tuple[float, float]]


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, class, target) from (source, source_size), one row per source.

    Targets share the sum of all sizes by weight. Where that is more than `most` times a source's size it gets just
    that, and the others share the rest. With sources by rising size per weight, the level that all targets per weight
    share is the largest of (words left when the sources before are full) / (weight from here on).
    Sources are ranked and summed in ranges, so their number is not bounded by what one task holds.
    """
    by_name = [F.col("source").asc_nulls_last()]
    named = earlier(ranged(sizes, *by_name), by_name, number=F.lit(1)).drop("part")
    classed = named.withColumn("class", (F.col("number") % len(weights)).cast("int")).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.col("class") + 1)
    )
    by_room = [F.col("source_size") / F.col("weight"), *by_name]
    filled = kept(earlier(ranged(classed, *by_room), by_room, words=F.col("source_size"), heavy=F.col("weight")))
    total = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("heavy")).first()
    left = F.lit(total.words).cast("bigint") - most * F.col("words")
    level = left.cast("double") / (F.lit(total.heavy).cast("bigint") - F.col("heavy"))
    share = F.lit(filled.agg(F.max(level)).first()[0]).cast("double") * F.col("weight")
    return filled.withColumn("target", F.least(share, (most * F.col("source_size")).cast("double"))).select(
        "source", "source_size", "class", "target"
    )


def time_of(share: Column, schedule: Schedule) -> Column:
    """Training time at which the schedule has met `share` (0 to 1) of its demand: the inverse of its integral."""
    pieces = [(t0, v0, t1 - t0, v1) for (t0, v0), (t1, v1) in zip(schedule, schedule[1:])]
    areas = [(v0 + v1) / 2 * width for _, v0, width, v1 in pieces]
    asked = share * sum(areas)
    found, done = None, 0.0
    for (start, rate, width, later), area in zip(pieces, areas):
        rest = asked - done
        root = F.sqrt(F.greatest(F.lit(rate * rate) + rest * (2 * (later - rate) / width), F.lit(0.0)))
        time = F.least(F.lit(start) + rest * 2 / (F.lit(rate) + root), F.lit(start + width))
        done += area
        found = F.when(asked <= done, time) if found is None else found.when(asked <= done, time)
    return F.coalesce(found, F.lit(float(schedule[-1][0])))


def assign(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, schedules: Sequence[Schedule] = SCHEDULES,
    seed: str = "mix", id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row (id, source, size, source_size, target, taken, passes) per row of `docs`.

    passes lists (pass, words, position): how many of the document's first words each pass over its source takes, if any, and
    the training position of the first. taken is their sum; a source's taken words are its rounded target, and a
    document is taken `most` times at most. NULL and empty texts have size 0 and are never taken. NULL is a source like
    any other, and a NULL id orders like an empty one; equal rows are taken one after the other. `carry` names columns of
    `docs` that come along as a struct `row`. No documents give no rows.

    A source's documents are counted in buckets of their hash first, so a source with most of the rows is
    neither sorted nor summed in one task; buckets per source are bounded, and a bucket's share of a source is even.
    """
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    columns = [F.col(id_column).alias("id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size")]
    rows = docs.select(*columns, order.alias("order"), *([F.struct(*carry).alias("row")] if carry else []))
    rows = rows.withColumn("bucket", F.substring("order", 1, 4))
    if not carry:
        rows = kept(rows)
    sums = kept(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    goals = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    below = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("size").over(below), F.lit(0)).alias("before"))
    offsets = offsets.alias("o").join(goals.alias("g"), F.expr("o.source <=> g.source")).select(
        F.col("o.source").alias("s"), F.col("bucket").alias("b"), "before", "source_size", "class", "target"
    )
    within = Window.partitionBy("source", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn(
        "from", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    )
    demand = F.floor(F.col("target") + 0.5)

    def taken(number: int) -> Column:
        start = F.col("from") + number * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), demand - start))
        share = F.try_divide(start.cast("double"), demand)
        position = F.when(F.col("class") == 0, time_of(share, schedules[0]))
        for at in range(1, len(weights)):
            position = position.when(F.col("class") == at, time_of(share, schedules[at % len(schedules)]))
        return F.struct(F.lit(number).alias("pass"), words.alias("words"), position.alias("position"))

    passes = F.filter(F.array(*map(taken, range(most))), lambda p: p.words > 0)
    return placed.withColumn("passes", passes).select(
        "id", "source", "size", "source_size", "target",
        F.aggregate("passes", F.lit(0).cast("bigint"), lambda total, p: total + p.words).alias("taken"),
        "passes", *(["row"] if carry else []),
    )


def training_rows(docs: DataFrame, **options) -> DataFrame:
    """Rows of `docs`, as often as the mix takes them, sorted by training position.

    Documents stay whole: where a source's demand ends within one, it counts as taken if at least half its words are.
    """
    mixed = assign(docs, carry=docs.columns, **options)
    copies = mixed.select("row", "id", "size", F.explode("passes").alias("p")).where(2 * F.col("p.words") >= F.col("size"))
    return copies.orderBy("p.position", "id", "p.pass").select("row.*")
