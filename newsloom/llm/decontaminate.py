"""Benchmark decontamination with suffix arrays of the training text.

Every task takes its documents in shards, sorts the shard's suffixes by prefix doubling, and binary-searches each test
suffix among them. What matches at the same distance in document and item is one longest verbatim match. Words that no
item has cannot be part of a match, so a shard keeps only runs of item words that are long enough. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from newsloom.llm.shared import in_tasks, sliced

WINDOW = 13
#: Bytes of item text per broadcast block; more items are searched block by block.
BLOCK_BYTES = 16 << 20

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z and characters above 0x7F once A-Z are lower-cased; NULL has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Items:
    """Test items of one block as one sequence of word numbers, 0 between items."""

    def __init__(self, texts: list[str | None], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        items = [np.array([number(w, len(self.vocabulary) + 1) for w in words_of(t)], np.int64) for t in texts]
        pieces = [np.zeros(1, np.int64)]
        for item in items:
            pieces += [item, np.zeros(1, np.int64)]
        self.words = np.concatenate(pieces)
        starts = np.cumsum([1, *(len(item) + 1 for item in items)])
        #: (length, test suffixes of that length's windows, their items, their places in the item)
        self.windows = []
        lengths = np.array([min(window, len(item)) for item in items], np.int64)
        for length in sorted({*lengths.tolist()} - {0}):
            own = [(starts[i] + k, i, k) for i in np.flatnonzero(lengths == length) for k in range(len(items[i]) - length + 1)]
            at, item, place = np.array(own, np.int64).T
            self.windows.append((int(length), at, item, place))
        self.shortest = min((w[0] for w in self.windows), default=0)

    def search(self, shard: np.ndarray) -> tuple[np.ndarray, ...]:
        """(shard position, item, place in item, length) of each occurrence of each window in the shard."""
        runs = _long_runs(shard > 0, self.shortest)
        if not self.windows or not len(runs):
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        kept = shard[runs]
        broken = np.flatnonzero(np.diff(runs) > 1) + 1
        kept, runs = np.insert(kept, broken, 0), np.insert(runs, broken, -1)
        both = np.concatenate([self.words, kept])
        found, ranks, depth = [], both, 1
        for length, at, item, place in self.windows:
            while depth * 2 <= length:
                ranks, depth = _ranked(ranks, depth), depth * 2
            keys = _pair(ranks, length - depth)
            suffixes = np.argsort(keys[len(self.words) :], kind="stable")
            ordered = keys[len(self.words) :][suffixes]
            low, high = np.searchsorted(ordered, keys[at], "left"), np.searchsorted(ordered, keys[at], "right")
            count = high - low
            which = np.repeat(np.arange(len(at)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            places = runs[suffixes[low[which] + nth]]
            found.append((places, item[which], place[which], np.full(len(which), length)))
        return tuple(np.concatenate(columns) for columns in zip(*found))


def _long_runs(mask: np.ndarray, shortest: int) -> np.ndarray:
    """Positions of the runs of true values that are at least `shortest` long."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= max(shortest, 1)
    marks = np.zeros(len(mask) + 1, np.int8)
    marks[starts[long]] += 1
    marks[ends[long]] -= 1
    return np.flatnonzero(np.cumsum(marks[:-1]))


def _pair(ranks: np.ndarray, shift: int) -> np.ndarray:
    """One number for what starts at a position and what starts `shift` later."""
    if shift == 0:
        return ranks.astype(np.int64)
    later = np.zeros_like(ranks)
    later[:-shift] = ranks[shift:]
    return ranks.astype(np.int64) * (int(ranks.max()) + 1) + later


def _ranked(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first 2 * depth words, from that by their first depth."""
    return np.unique(_pair(ranks, depth), return_inverse=True)[1].astype(np.int64)


def _matches(found: tuple[np.ndarray, ...]) -> np.ndarray:
    """Rows (start, item, place, length): windows that follow each other at one distance become one match."""
    start, item, place, length = found
    if not len(start):
        return np.zeros((0, 4), np.int64)
    order = np.lexsort((start, start - place, item))
    start, item, place, length = start[order], item[order], place[order], length[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (np.diff(item) != 0) | (np.diff(start - place) != 0) | (np.diff(start) != 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    return np.stack([start[first], item[first], place[first], start[last] + length[last] - start[first]], axis=1)


def _blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for row in items.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).orderBy("i", "t").toLocalIterator():
        if size and size + len(row.t or "") > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t or "")
    yield ids, texts


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
    item_id_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """One row (id, n_words, n_hit, items, matches) per row of `docs`.

    A window is `window` consecutive words of an item, or the whole item if it has fewer but any. n_hit counts document
    words inside an occurrence of a window; items are the distinct ids of items with one, in order; matches are the
    longest verbatim matches (item_id, doc_word, item_word, n_words), places counted in words from 0. NULL and empty
    texts have no words; items without words never match; an item without id counts in n_hit and matches, not in items;
    rows that share an item id are one item. Other columns are ignored, equal rows come out as often as they came in.
    """
    return _found(docs, items, window, id_column, text_column, item_id_column, item_text_column).drop("hash")


def _found(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
    item_id_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """The rows of `contamination` with the hash of their text, which tells apart texts that share an id."""
    item_type = items.schema[item_id_column].dataType.simpleString()
    found = [_scan(docs, block, window, id_column, text_column, item_type) for block in _blocks(items, item_id_column, item_text_column)]
    if len(found) == 1:
        return found[0]
    hits = found[0]
    for other in found[1:]:
        hits = hits.unionByName(other)
    spans = F.array_sort(F.flatten(F.collect_list("matches")), lambda a, b: F.sign(a.doc_word - b.doc_word).cast("int"))
    covered = F.aggregate(
        "matches",
        F.struct(F.lit(0).cast("bigint").alias("to"), F.lit(0).cast("bigint").alias("n")),
        lambda s, m: F.struct(
            F.greatest(s.to, m.doc_word + m.n_words).alias("to"),
            (s.n + F.greatest(F.lit(0), m.doc_word + m.n_words - F.greatest(s.to, m.doc_word))).alias("n"),
        ),
        lambda s: s.n,
    )
    copies = F.count("*") / len(found)
    return (
        hits.groupBy("id", "hash", "n_words")
        .agg(spans.alias("matches"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), copies.cast("int").alias("copies"))
        .select("id", "hash", "n_words", covered.alias("n_hit"), "items", "matches", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
        .drop("copy")
    )


def _scan(docs: DataFrame, block: tuple[list, list], window: int, id_column: str, text_column: str, item_type: str) -> DataFrame:
    chosen = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("hash")
    )
    sent = docs.sparkSession.sparkContext.broadcast(block)
    match = f"struct<item_id:{item_type},doc_word:bigint,item_word:bigint,n_words:bigint>"
    rest = T._parse_datatype_string(f"n_words bigint, n_hit bigint, items array<{item_type}>, matches array<{match}>")
    shape = T.StructType([chosen.schema["id"], chosen.schema["hash"], *rest])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = sent.value
        tests = Items(texts, window)
        for batch in sliced(batches, 1, 4 << 20):
            yield _report(batch, tests, ids, shape)

    return in_tasks(chosen, scan, shape)


def _report(batch: pa.RecordBatch, tests: Items, ids: list, shape: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    number = tests.vocabulary.get
    counts, parts, gap = [], [], np.zeros(1, np.int64)
    for text in batch.column(1):
        words = words_of(text.as_py())
        counts.append(len(words))
        parts += [np.fromiter(map(number, words, repeat(0)), np.int64, len(words)), gap]
    shard = np.concatenate(parts)
    starts = np.cumsum([0, *(n + 1 for n in counts)])
    found = tests.search(shard)
    marks = np.zeros(len(shard) + 1, np.int64)
    np.add.at(marks, found[0], 1)
    np.add.at(marks, found[0] + found[3], -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
    rows = _matches(found)
    owner = np.searchsorted(starts, rows[:, 0], "right") - 1
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0], owner))]
    owner = np.sort(owner)
    cuts = np.searchsorted(owner, np.arange(len(counts) + 1))
    lists, spans = [], []
    for at in range(len(counts)):
        own = rows[cuts[at] : cuts[at + 1]]
        lists.append(sorted({ids[i] for i in own[:, 1]} - {None}))
        spans.append([{"item_id": ids[i], "doc_word": s - starts[at], "item_word": p, "n_words": n} for s, i, p, n in own.tolist()])
    arrow = to_arrow_schema(shape)
    n_hit = hit[starts[1:] - 1] - hit[starts[:-1]]
    columns = [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(n_hit)]
    columns += [pa.array(lists, arrow.field("items").type), pa.array(spans, arrow.field("matches").type)]
    return pa.RecordBatch.from_arrays(columns, names=arrow.names)


def decontaminate(
    docs: DataFrame, items: DataFrame, share: int = 20, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """Rows of `docs` whose hit words are fewer than one in `share`.

    Rows that share an id, or have none, are judged each by its own text.
    """
    found = _found(docs, items, id_column=id_column, text_column=text_column, **options)
    bad = found.where((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    lost = bad.select(F.col("id").alias("_lost"), F.col("hash").alias("_hash")).distinct()
    same = docs[id_column].eqNullSafe(lost["_lost"]) & (F.xxhash64(docs[text_column]) == lost["_hash"])
    return docs.join(lost, same, "left_anti")
