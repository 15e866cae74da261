"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints that differ in at most `limit` of 64 bits differ, for any partition of the bits into
groups with thresholds e_i where the e_i + 1 add up to limit + 1, in at most e_i bits of some group. Groups
collect correlated bits, so that the groups' keys tell apart as much as they can, and a dynamic
programme gives each group the threshold that makes the estimated work least. Every fingerprint
probes, in each group, all keys within the group's threshold; whatever it meets is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsloom.llm.shared import components, in_tasks, kept, sliced

BITS = 64
#: XXH64 seed of a shingle's hash.
SEED = 42
#: Fingerprints that share a group's key before they are compared in blocks and not by a join.
HOT_KEY = 256
#: Fingerprints per side of a block.
BLOCK = 1024
#: Work of shuffling one probe against that of verifying one candidate.
PROBE_COST = 3.0


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of a text as unsigned 64-bit number; 0 without words.

    A-Z are lower-cased, words are what ASCII white space separates, `shingle` words make a shingle, repeats count,
    and a text of fewer words is one shingle. A bit is set if more than half the shingles' hashes set it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [end + at for at, end in enumerate(accumulate(map(len, words)))]
    starts = [0, *(end + 1 for end in ends[:-shingle])]
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :] or ends[-1:])], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, text_hash: bool = False
) -> DataFrame:
    """One row (id, fingerprint) per row of `docs`; the fingerprint is the signed form of its 64 bits.

    With `text_hash` a column `hash` tells apart texts that share an id.
    """
    columns = [F.col(id_column).alias("id"), F.col(text_column).alias("text")]
    chosen = docs.select(*columns, *([F.xxhash64(text_column).alias("hash")] if text_hash else []))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            columns = [batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "fingerprint", *batch.schema.names[2:]])

    kind = [chosen.schema["id"], T.StructField("fingerprint", T.LongType(), False), *chosen.schema.fields[2:]]
    return in_tasks(chosen, take, T.StructType(kind))


# --- the plan: groups of bits and their thresholds --------------------------------------


def bit_statistics(values: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, how often each bit is set, and how often each two are; 64 x 64 figures in all."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            total += len(raw)
        cells = np.append(both.ravel(), total).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    rows = in_tasks(values, tally, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for row in rows:
        cells[row.cell] = row.n
    both = cells[:-1].reshape(BITS, BITS)
    return int(cells[-1]), np.diag(both).copy(), both


def bit_groups(total: int, ones: np.ndarray, both: np.ndarray, groups: int) -> list[list[int]]:
    """The 64 bits in `groups` groups of nearly equal size, correlated bits together.

    Each group starts with the most correlated pair left and takes the bit that correlates most with it.
    """
    share = ones / max(total, 1)
    deviation = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tie = np.abs((both / max(total, 1) - np.outer(share, share)) / np.outer(deviation, deviation))
    np.fill_diagonal(tie, 0)
    left, found = list(range(BITS)), []
    for at in range(groups):
        width = BITS // groups + (at < BITS % groups)
        inner = tie[np.ix_(left, left)]
        group = [left[int(np.argmax(inner.max(axis=1)))]]
        left.remove(group[0])
        while len(group) < width:
            best = left[int(np.argmax(tie[np.ix_(left, group)].sum(axis=1)))]
            group.append(best)
            left.remove(best)
        found.append(sorted(group))
    return found


def within(group: list[int], share: np.ndarray, limit: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0, 1 .. limit bits of the group, if its bits were independent."""
    chance = [1.0] + [0.0] * limit
    for bit in group:
        differ = 2 * share[bit] * (1 - share[bit])
        chance = [c * (1 - differ) + (chance[k - 1] * differ if k else 0.0) for k, c in enumerate(chance)]
    return list(accumulate(chance))


def allocate(costs: list[list[float]], limit: int) -> list[int]:
    """Thresholds of least total cost whose values plus one add up to limit + 1; -1 leaves a group out.

    costs[i][e] is the work of group i at threshold e. Ties go to the smaller threshold of the earlier group.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (work, chosen) in best.items():
            for units in range(limit + 2 - spent):
                value = work + (cost[units - 1] if units else 0.0)
                if spent + units not in step or value < step[spent + units][0]:
                    step[spent + units] = (value, [*chosen, units - 1])
        best = step
    return best[limit + 1][1]


def probe_plan(values: DataFrame, limit: int) -> list[tuple[int, list[int]]]:
    """(mask, changes) per group that is probed: its bits, and what to flip in a key for each probe."""
    total, ones, both = bit_statistics(values)
    share = ones / max(total, 1)

    def work(groups: list[list[int]], collisions: list[float]) -> list[list[float]]:
        return [
            [
                PROBE_COST * total * sum(comb(len(group), k) for k in range(e + 1))
                + collided / 2 * chance[e] / max(chance[0], 1e-18)
                for e in range(min(limit, len(group)) + 1)
            ]
            for group, collided in zip(groups, collisions)
            for chance in [within(group, share, limit)]
        ]

    def guess(groups: list[list[int]]) -> float:
        costs = work(groups, [float(total) ** 2 * within(g, share, 0)[0] + total for g in groups])
        return sum(cost[e] for cost, e in zip(costs, allocate(costs, limit)) if e >= 0)

    choices = [bit_groups(total, ones, both, n) for n in range(1 + (limit > 0), limit + 2)]
    groups = min(choices, key=guess)
    masks = [sum(1 << bit for bit in group) for group in groups]
    counted = (
        values.select(F.explode(_keys("fingerprint", [(m, [0]) for m in masks])).alias("k"))
        .groupBy("k")
        .count()
        .groupBy("k.part")
        .agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs"))
    )
    pairs = {row.part: row.pairs for row in counted.collect()}
    collisions = [pairs.get(at, 0.0) for at in range(len(groups))]
    thresholds = allocate(work(groups, collisions), limit)
    return [
        (mask, [sum(1 << b for b in flip) for k in range(e + 1) for flip in combinations(group, k)])
        for mask, group, e in zip(masks, groups, thresholds)
        if e >= 0
    ]


# --- probe and verify ---------------------------------------------------------------------


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _keys(column: str, plan: list[tuple[int, list[int]]]) -> Column:
    """Array of (part, key): in every group the key with each of its changes."""

    def group(part: int, mask: int, changes: list[int]) -> Column:
        key = F.col(column).bitwiseAND(F.lit(_signed(mask)))
        flips = F.array(*[F.lit(_signed(c)).cast("bigint") for c in changes])
        return F.transform(flips, lambda flip: F.struct(F.lit(part).alias("part"), key.bitwiseXOR(flip).alias("key")))

    return F.concat(*[group(part, mask, changes) for part, (mask, changes) in enumerate(plan)])


def _close(a: str, b: str, limit: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= limit


def links(values: DataFrame, limit: int = 4) -> DataFrame:
    """Links (a, b) that connect all fingerprints of `values` (one distinct bigint column) within `limit` bits.

    Keys that few fingerprints share are joined. A key that more than HOT_KEY share is compared in blocks, which report
    a spanning forest of their links instead of all of them: each fingerprint with the smallest it reaches there.
    """
    plan = probe_plan(values, limit)
    stored = values.select(F.col("fingerprint").alias("a"), F.explode(_keys("fingerprint", [(m, [0]) for m, _ in plan])).alias("k"))
    stored = stored.select("k.part", "k.key", "a")
    probes = values.select(F.col("fingerprint").alias("b"), F.explode(_keys("fingerprint", plan)).alias("k"))
    probes = probes.select("k.part", "k.key", "b")
    hot = kept(stored.groupBy("part", "key").count().where(F.col("count") > HOT_KEY))
    if hot.isEmpty():
        return stored.join(probes, ["part", "key"]).where((F.col("a") < F.col("b")) & _close("a", "b", limit)).select("a", "b")
    cold = (
        stored.join(hot, ["part", "key"], "left_anti")
        .join(probes, ["part", "key"])
        .where((F.col("a") < F.col("b")) & _close("a", "b", limit))
        .select("a", "b")
    )
    asked = probes.join(hot.select("part", "key"), ["part", "key"])
    parts = kept(
        asked.groupBy("part", "key")
        .agg(F.count("*").alias("asked"))
        .join(hot, ["part", "key"])
        .select(
            "part", "key",
            F.ceil(F.col("count") / BLOCK).alias("blocks"),
            F.ceil(F.col("asked") / BLOCK).alias("chunks"),
        )
    )

    def spread(column: str, own: str, other: str) -> list[Column]:
        mine = F.pmod(F.xxhash64(column), F.col(own)).alias(own)
        return [mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)]

    left = stored.join(parts, ["part", "key"]).select(
        "part", "key", *spread("a", "blocks", "chunks"), F.col("a").alias("value"), F.lit(True).alias("is_stored")
    )
    right = asked.join(parts, ["part", "key"]).select(
        "part", "key", *spread("b", "chunks", "blocks"), F.col("b").alias("value"), F.lit(False).alias("is_stored")
    )
    cells = left.unionByName(right).groupBy("part", "key", "blocks", "chunks")
    return cold.union(cells.applyInArrow(lambda cell: _forest(cell, limit), "a bigint, b bigint"))


def _forest(cell: pa.Table, limit: int) -> pa.Table:
    """Each fingerprint of a block with the smallest that links within the block lead to."""
    value = cell.column("value").to_numpy().astype(np.int64)
    stored = cell.column("is_stored").to_numpy(zero_copy_only=False)
    rows, columns = value[stored], np.unique(value[~stored])
    if not len(rows) or not len(columns):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    near = np.bitwise_count((rows[:, None] ^ columns[None, :]).view(np.uint64)) <= limit
    top = np.iinfo(np.int64).max
    low_r, low_c = rows.copy(), columns.copy()
    while True:
        new_r = np.minimum(low_r, np.where(near, low_c[None, :], top).min(axis=1))
        new_c = np.minimum(low_c, np.where(near, new_r[:, None], top).min(axis=0))
        if (new_r == low_r).all() and (new_c == low_c).all():
            break
        low_r, low_c = new_r, new_c
    ends = np.unique(np.stack([np.concatenate([low_r, low_c]), np.concatenate([rows, columns])], axis=1), axis=0)
    ends = ends[ends[:, 0] != ends[:, 1]]
    return pa.table({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, limit: int = 4,
    text_hash: bool = False,
) -> DataFrame:
    """One row (id, fingerprint, component_id) per row of `docs`, with `text_hash` also the text's hash and the component.

    Fingerprints that differ in at most `limit` bits are linked; component_id is the smallest id of all
    documents that links lead to, a document's own included. NULL and empty texts have fingerprint 0 and link like
    any other; rows with a NULL id take part but lend their id to no component; equal rows come out as often
    as they came in. Columns of `docs` beside the two are ignored. An empty table gives no rows.

    Copies share a fingerprint and count once from the first shuffle on; work is per distinct fingerprint.
    """
    signed = kept(fingerprints(docs, id_column, text_column, shingle, text_hash))
    distinct = kept(signed.groupBy("fingerprint").agg(F.min("id").alias("first")))
    joined = components(links(distinct.select("fingerprint"), limit))
    placed = distinct.join(joined.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint")
    )
    smallest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "component").select("fingerprint", "component_id", "component")
    return signed.join(named, "fingerprint").select("id", "fingerprint", "component_id", *(["hash", "component"] if text_hash else []))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row of `docs` for each component: with an id before without, then of the smallest id, then of the smallest text hash.

    So a component of rows without an id keeps one of them, and one that also has rows with an id keeps one of those. Rows that
    share an id are judged each by its own text, so that one group's loss never takes another group's last document. NULL and
    empty texts are one group. Of rows equal in id and text one stays, the smallest by all columns; they are combined before
    the shuffle, so one repeated in most of the input never meets in one task. No documents give no rows.
    """
    found = near_duplicates(docs, id_column, text_column, text_hash=True, **options)
    # A text has one fingerprint, so id and hash stand for a component.
    counts = found.groupBy("component", "id", "hash").agg(F.count("*").alias("n"))
    left = kept(
        counts.groupBy("component")
        .agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "hash", "n")).alias("best"))
        .select(F.col("best.id").alias("_id"), F.col("best.hash").alias("_hash"), F.col("best.n").alias("_n"))
    )

    def rows_of(chosen: DataFrame) -> DataFrame:
        same = docs[id_column].eqNullSafe(chosen["_id"]) & (F.xxhash64(docs[text_column]) == chosen["_hash"])
        return docs.join(chosen, same, "left_semi")

    repeated = rows_of(left.where("_n > 1")).groupBy(F.col(id_column).alias("_id"), F.xxhash64(text_column).alias("_hash"))
    combined = repeated.agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return rows_of(left.where("_n = 1")).union(combined)
