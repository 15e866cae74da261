"""Token counts of texts by a two-tier lookup of pre-token lengths.

The tokenizer cuts a text into pre-tokens and merges within each, so a text's count is the sum over its pre-tokens. A
compact table with the lengths of frequent pre-tokens is broadcast; misses are encoded by the library once per
worker and remembered there. Pre-tokens are never shuffled: what finds the frequent ones are summaries of bounded size, one
per task, over all texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from newsloom.llm.shared import in_tasks, kept, sliced
from newsloom.llm.tokenizing import LengthCounter, units_of, worker

#: Bounds of the broadcast table: entries, and the length of an entry in characters.
TABLE_ENTRIES, ENTRY_CHARS = 1 << 16, 64
#: Units a task's summary passes on, and units it may hold while it counts.
SUMMARY, HELD = 1 << 14, 1 << 18
#: Bins of a unit's number per doubling.
BINS = 8


def _cut(seen: Counter[str], entries: int) -> Counter[str]:
    """A frequent-items summary of at most `entries` units: all counts less the largest that has no room.

    A unit is lost only if it was counted no more often than what was taken off, which is at most the
    number of all units over `entries`.
    """
    if len(seen) <= entries:
        return seen
    counts = np.fromiter(seen.values(), np.int64, len(seen))
    off = int(np.partition(counts, len(counts) - entries - 1)[len(counts) - entries - 1])
    return Counter({unit: n - off for unit, n in seen.items() if n > off})


def frequent_units(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(unit, n): the units (runs of pre-tokens between spaces) frequent in all of `docs`, with a lower bound of their number.

    Each task counts its whole texts in a summary of bounded size; only summaries are added up, SUMMARY rows a task at most.
    Units of more than ENTRY_CHARS characters and units met once are left out, NULL texts have none.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for part in sliced([batch], 0):
                for text in part.column(0):
                    seen.update(units_of(text.as_py() or ""))
                if len(seen) > HELD:
                    seen = _cut(seen, HELD // 2)
        usable = Counter({unit: n for unit, n in seen.items() if n > 1 and 0 < len(unit) <= ENTRY_CHARS and "\0" not in unit})
        chosen = _cut(usable, SUMMARY)
        columns = [pa.array(chosen.keys(), pa.string()), pa.array(chosen.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["unit", "n"])

    found = in_tasks(docs.select(text_column), summarise, "unit string, n bigint")
    return found.groupBy("unit").agg(F.sum("n").alias("n"))


def frequent_lengths(docs: DataFrame, tokenizer: str, text_column: str = "text") -> tuple[bytes, bytes]:
    """The most frequent units of all rows, NUL-joined, and their lengths, one byte each.

    At most TABLE_ENTRIES of at most ENTRY_CHARS characters: some MB at most, whatever the size of `docs`. What the table
    lacks is encoded as it comes, so it decides how many misses there are, never a count. Units are taken by bins of their
    number, so the driver gets a few hundred bin sizes and the units of the bins that fit as a whole, no more.
    """
    bin_of = F.floor(F.log2("n") * BINS).cast("int")
    found = kept(frequent_units(docs, text_column)).withColumn("bin", bin_of)
    sizes = found.groupBy("bin").count().orderBy(F.desc("bin")).collect()
    fitting = [row.bin for row, total in zip(sizes, accumulate(row["count"] for row in sizes)) if total <= TABLE_ENTRIES]
    chosen = found.where(F.col("bin") >= min(fitting)).collect() if fitting else []
    units = [row.unit for row in sorted(chosen, key=lambda row: (-row.n, row.unit))]
    tool = worker(LengthCounter, tokenizer)
    # ENTRY_CHARS characters are at most 4 bytes each, so at most 256 tokens; a length that needs two bytes is left out.
    lengths = [tool.unit_length(unit) for unit in units]
    short = [(unit, n) for unit, n in zip(units, lengths) if n < 256]
    return "\0".join(unit for unit, _ in short).encode(), bytes(n for _, n in short)


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row (id, n_bytes, n_tokens, over_limit) per row of `docs`, counted over whole texts.

    The tokenizer is a byte-level BPE file of the tokenizers library that splits by public_tokenizers.PATTERN. NULL texts
    count as empty: 0 bytes, 0 tokens. Ids may repeat or be NULL; other columns are ignored; no rows give no rows.
    """
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer, text_column))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, lengths = table.value
        frequent = dict(zip(tokens.decode().split("\0"), lengths)) if lengths else {}
        tool = worker(LengthCounter, tokenizer)
        for batch in sliced(batches, 1):
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0)
            totals = np.array([tool.count(t.as_py() or "", frequent) for t in batch.column(1)], np.int64)
            columns = [batch.column(0), sizes.cast(pa.int64()), pa.array(totals), pa.array(totals > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "over_limit"])

    rest = T._parse_datatype_string("n_bytes bigint, n_tokens bigint, over_limit boolean")
    return in_tasks(chosen, count, T.StructType([chosen.schema["id"], *rest]))
