"""Quality rules whose cutoffs come from the documents: quantile sketches per language and source, merged upwards.

A document's figures are shares, kept as whole numbers. A sketch counts the documents of a group per figure and bin, a
figure rounded down to BITS significant bits, so that a quantile is right to one part in 2 ** (BITS - 1). Counts of one
group add up to those of a wider one, in any order and any number of tasks. The cutoffs of a group are fences
around its middle half; small groups take those of their language, or of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from newsloom.llm.shared import in_tasks, kept, sliced

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Fewer words fail, and more than this share (in hundredths) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Significant bits of a sketch's bins.
BITS = 7
#: Documents a group needs for cutoffs of its own.
OWN_ROWS = 100
#: A fence lies this many interquartile ranges beyond the quartiles.
RANGES = 3
#: Figure: (SQL of its whole number, least distance of a fence from its quartile, whether low values fail as well).
FIGURES = {
    "word_length": ("word_chars * 100 div greatest(n_words, 1)", 200, True),
    "symbols": ("n_symbols * 10000 div greatest(word_chars, 1)", 300, False),
    "repeated_lines": ("n_dup_lines * 10000 div greatest(n_lines, 1)", 3000, False),
    "repeated_words": ("n_repeat_words * 10000 div greatest(n_words, 1)", 3000, False),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

_CONTINUED = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that stand at least twice in `words`; equal windows are found by ranks of growing runs."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ranks = np.array([number.setdefault(word, len(number)) for word in words], np.int64)
    if len(number) == len(words):
        return 0
    length = 1
    while length < window:
        step = min(length, window - length)
        pairs = ranks[: len(ranks) - step] * (int(ranks.max()) + 1) + ranks[step:]
        found, ranks = np.unique(pairs, return_inverse=True)
        if len(found) == len(ranks):
            return 0
        length += step
    starts = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    change[starts] += 1
    change[starts + window] -= 1
    return int(np.count_nonzero(np.cumsum(change)))


def counts(text: bytes) -> tuple[int, ...]:
    """The figures of COUNTS of one text in UTF-8; words are what ASCII white space separates."""
    words = text.split()
    joined = b"".join(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(joined.translate(None, _CONTINUED)),
        len(joined) - len(joined.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def document_counts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
    source_column: str = "source",
) -> DataFrame:
    """One row (id, lang, source, COUNTS, base_failed) per row of `docs`. NULL and empty texts have no words and fail."""
    chosen = docs.select(
        F.col(id_column).alias("id"),
        F.col(lang_column).cast("string").alias("lang"),
        F.col(source_column).cast("string").alias("source"),
        F.col(text_column).cast("binary").alias("text"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 3):
            found = np.array([counts(text.as_py() or b"") for text in batch.column(3)], np.int64).reshape(-1, len(COUNTS))
            columns = [pa.array(found[:, at]) for at in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["id", "lang", "source", *COUNTS])

    shape = T.StructType([*chosen.schema.fields[:3], *(T.StructField(name, T.LongType(), False) for name in COUNTS)])
    words, repeated = F.col("n_words"), F.col("n_repeat_words")
    failed = (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)
    return in_tasks(chosen, count, shape).withColumn("base_failed", failed)


def binned(value: Column) -> Column:
    """`value` with all but its BITS leading bits cleared."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - BITS).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """(level, lang, source, figure, bin, n): sketches of level 0 per language and source, of 1 per language and of 2 of all.

    Every document with a word counts. Bins are counted inside the map tasks, so a source with most of the rows meets as a few
    hundred counts a task; the wider levels add up counts, not documents.
    """
    listed = F.array(*(F.struct(F.lit(name).alias("figure"), binned(F.expr(text)).alias("bin")) for name, (text, *_) in FIGURES.items()))
    own = kept(
        measured.where("n_words > 0")
        .select("lang", "source", F.explode(listed).alias("f"))
        .groupBy("lang", "source", "f.figure", "f.bin")
        .agg(F.count("*").alias("n"))
    )
    nothing = F.lit(None).cast("string")
    by_lang = own.groupBy("lang", "figure", "bin").agg(F.sum("n").alias("n"))
    whole = own.groupBy("figure", "bin").agg(F.sum("n").alias("n"))
    return (
        own.select(F.lit(0).alias("level"), "lang", "source", "figure", "bin", "n")
        .union(by_lang.select(F.lit(1), "lang", nothing, "figure", "bin", "n"))
        .union(whole.select(F.lit(2), nothing, nothing, "figure", "bin", "n"))
    )


def fences(sketched: DataFrame) -> DataFrame:
    """(level, lang, source, figure, rows, low, high) per sketch; low is NULL where low values pass.

    A quantile is the first bin at which the counts reach its share. The running sums are over a sketch's bins, some
    hundreds at most, whatever its number of documents.
    """
    one = ["level", "lang", "source", "figure"]
    within = Window.partitionBy(*one)
    reached = F.sum("n").over(within.orderBy("bin"))
    quartiles = (
        sketched.withColumns({"rows": F.sum("n").over(within), "reached": reached})
        .groupBy(*one)
        .agg(
            F.max("rows").alias("rows"),
            F.min(F.when(4 * F.col("reached") >= F.col("rows"), F.col("bin"))).alias("q1"),
            F.min(F.when(4 * F.col("reached") >= 3 * F.col("rows"), F.col("bin"))).alias("q3"),
        )
    )
    least = F.create_map(*(F.lit(part) for name, (_, margin, _) in FIGURES.items() for part in (name, margin)))
    both = [name for name, (*_, two_sided) in FIGURES.items() if two_sided]
    away = F.greatest(RANGES * (F.col("q3") - F.col("q1")), least[F.col("figure")].cast("bigint"))
    return quartiles.select(
        *one, "rows", F.when(F.col("figure").isin(both), F.col("q1") - away).alias("low"), (F.col("q3") + away).alias("high")
    )


def cutoffs(sketched: DataFrame, own_rows: int = OWN_ROWS) -> DataFrame:
    """(lang, source, low_<figure>, high_<figure> ...), one row per language and source: of the narrowest group with `own_rows`."""
    found = kept(fences(sketched))
    own, lang, whole = (found.where(F.col("level") == level).alias(f"l{level}") for level in range(3))
    joined = own.join(lang, F.expr("l0.lang <=> l1.lang AND l0.figure = l1.figure")).join(whole, F.expr("l0.figure = l2.figure"))
    level = F.when(F.col("l0.rows") >= own_rows, 0).when(F.col("l1.rows") >= own_rows, 1).otherwise(2)

    def taken(name: str) -> Column:
        return F.when(level == 0, F.col(f"l0.{name}")).when(level == 1, F.col(f"l1.{name}")).otherwise(F.col(f"l2.{name}"))

    picked = joined.select(F.col("l0.lang").alias("lang"), F.col("l0.source").alias("source"), F.col("l0.figure").alias("figure"), taken("low").alias("low"), taken("high").alias("high"))
    return picked.groupBy("lang", "source").agg(
        *(
            F.max(F.when(F.col("figure") == name, F.col(side))).alias(f"{side}_{name}")
            for name in FIGURES
            for side in ("low", "high")
        )
    )


def judge(docs: DataFrame, own_rows: int = OWN_ROWS, **columns: str) -> DataFrame:
    """One row (id, lang, source, COUNTS, base_failed, kept, reasons) per row of `docs`.

    kept is false if the base rules fail or a figure lies beyond a cutoff of the document's language and source; reasons names
    those figures. NULL and empty texts fail. NULL is a language and a source like any other; groups of fewer than `own_rows`
    documents with words take the cutoffs of their language, and if that has too few those of all documents. Equal rows
    are judged alike and come out as often as they came in; ids may be NULL or repeat; other columns are ignored; an
    empty table gives no rows. Texts are read once, and only figures are shuffled.
    """
    measured = kept(document_counts(docs, **columns))
    limits = kept(cutoffs(sketches(measured), own_rows)).toDF("_lang", "_source", *(f"{s}_{n}" for n in FIGURES for s in ("low", "high")))
    joined = measured.join(limits, measured["lang"].eqNullSafe(limits["_lang"]) & measured["source"].eqNullSafe(limits["_source"]), "left")
    beyond = []
    for name, (text, *_) in FIGURES.items():
        value = F.expr(text)
        outside = (value > F.col(f"high_{name}")) | (value < F.col(f"low_{name}"))
        beyond.append(F.when(outside, F.lit(name)))
    reasons = F.array_compact(F.array(*beyond))
    return joined.select("id", "lang", "source", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size(reasons) == 0)).alias("kept"), reasons.alias("reasons"))
