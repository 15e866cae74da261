"""Languages of a document as a mixture, found by expectation-maximisation over its character trigrams.

A language is a smoothed distribution over trigram buckets, learned from labelled rows. A document's proportions
maximise the likelihood of its trigrams; the set of languages grows from the best single one for as long as another
raises the likelihood by more than a penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from newsloom.llm.shared import in_tasks, sliced

UNKNOWN = "und"
BUCKETS = 1 << 16
#: Labelled documents per language that a model learns from, chosen by a hash of their id.
SAMPLE_PER_LANGUAGE = 1000
#: Labels that a model learns at most, those of the most rows: it bounds the model, BUCKETS chances each, that every task holds.
MOST_LANGUAGES = 256
#: Added to each bucket's count.
SMOOTHING = 0.5
#: Of a further language, times the logarithm of the number of trigrams; three times the usual half, since they overlap.
PENALTY = 3 * 0.5
STEPS, CLOSE = 40, 1e-4

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each trigram of the lower-cased letters, words parted by one space; none without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _LETTER[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        letter[high] = [chr(c).isalpha() for c in points[high]]
    if not letter.any():
        return np.zeros(0, np.uint32)
    folded = np.where(letter, points, 32)
    folded = np.concatenate([[32], folded, [32]]).astype(np.uint32)
    folded = folded[np.append(True, (folded[1:] != 32) | (folded[:-1] != 32))]
    mixed = folded[:-2] * np.uint32(0x9E3779B1) ^ folded[1:-1] * np.uint32(0x85EBCA77) ^ folded[2:] * np.uint32(0xC2B2AE3D)
    return mixed >> np.uint32(16)


def counted(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(buckets) < 1500:
        return np.unique(buckets, return_counts=True)
    counts = np.bincount(buckets, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass
class Model:
    """Languages in order and the chance of each bucket in each, one row per bucket."""

    languages: list[str]
    chances: np.ndarray

    def mixture(self, text: str | None) -> list[tuple[str, float]]:
        """Languages of a text with their shares, largest first; empty without a letter or a learned language."""
        buckets, counts = counted(trigrams(text))
        if not len(buckets) or not self.languages:
            return []
        chances, total = self.chances[buckets], float(counts.sum())
        alone = counts @ np.log(chances)
        best = int(np.argmax(alone))
        penalty = PENALTY * np.log(max(total, 2.0))
        every, top = _fit(chances, counts, total)
        chosen, shares, reached = [best], np.ones(1), alone[best]
        rest = [int(other) for other in np.argsort(-every, kind="stable") if other != best and every[other] > 0]
        while rest and top - reached > penalty:
            fits = [_fit(chances[:, [*chosen, other]], counts, total) for other in rest]
            at = max(range(len(rest)), key=lambda k: fits[k][1])
            if fits[at][1] - reached <= penalty:
                break
            shares, reached = fits[at]
            chosen.append(rest.pop(at))
        order = np.argsort(-shares, kind="stable")
        return [(self.languages[chosen[k]], float(min(1.0, shares[k]))) for k in order]


def _fit(chances: np.ndarray, counts: np.ndarray, total: float) -> tuple[np.ndarray, float]:
    """Proportions of most likelihood, and its logarithm."""
    shares = np.full(chances.shape[1], 1 / chances.shape[1])
    for _ in range(STEPS):
        mixed = chances @ shares
        moved = shares * (chances.T @ (counts / mixed)) / total
        done = np.abs(moved - shares).max() < CLOSE
        shares = moved
        if done:
            break
    return shares, float(counts @ np.log(chances @ shares))


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 2 over 4."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang",
          per_language: int = SAMPLE_PER_LANGUAGE, languages: int = MOST_LANGUAGES) -> Model:
    """The model of the labelled rows of `docs`: of their `languages` most frequent labels, ties to the smaller.

    Per language it takes the `per_language` rows of smallest id hash, of several rows of one id and label those; counting is
    spread over the tasks. Only rows below a bound on that hash are shuffled, some twice `per_language` a language. What reaches the
    driver are the counts, languages x BUCKETS at most. Rows without a label or text teach nothing; no rows give an
    empty model.
    """
    usable = docs.where(F.col(label_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(label_column).alias("label")
    )
    usable = usable.withColumn("order", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("language")), F.lit(1 << 40)))
    keyed = usable.select("id", "label", "order")
    sizes = keyed.groupBy("label").count().orderBy(F.desc("count"), "label").limit(languages).collect()
    # Twice the share that is asked for leaves enough rows and bounds what meets in a language's window.
    near = F.lit(False)
    for row in sizes:
        share = min(1.0, (2 * per_language + 100) / row["count"])
        near = near | ((F.col("label") == row.label) & (F.col("order") <= int(share * (1 << 40))))
    ranked = Window.partitionBy("label").orderBy("order", "id")
    chosen = keyed.where(near).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= per_language)
    # The bound leaves few rows, so the join moves no other text.
    picked = usable.where(near).drop("order").join(chosen.select("id", "label"), ["id", "label"], "left_semi")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                own = sums.setdefault(label, np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for label, counts in sums.items():
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(found)), pa.array(found.astype(np.int32)), pa.array(counts[found])], ["label", "bucket", "n"]
            )

    rows = in_tasks(picked, tally, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    counts = rows.toArrow()
    languages = sorted(row.label for row in sizes)
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    place = {label: at for at, label in enumerate(languages)}
    columns = np.array([place[label] for label in counts.column("label").to_pylist()], np.int64)
    table[counts.column("bucket").to_numpy(), columns] += counts.column("n").to_numpy()
    return Model(languages, table / table.sum(axis=0))


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row (id, lang_pred, score, mixture) per row of `docs`; only the text is looked at.

    lang_pred is the language of the largest share and score that share; NULL texts and texts without a letter are
    `und` with score 0 and an empty mixture, as is everything if nothing was learned. Ties go to the language that
    sorts first. Other columns are ignored and equal rows come out as often as they came in.
    """
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    part = pa.struct([("lang", pa.string()), ("share", pa.float64())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in sliced(batches, 1):
            found = [model.mixture(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([m[0][0] if m else UNKNOWN for m in found], pa.string()),
                    pa.array([m[0][1] if m else 0.0 for m in found], pa.float64()),
                    pa.array([[{"lang": a, "share": b} for a, b in m] for m in found], pa.list_(part)),
                ],
                ["id", "lang_pred", "score", "mixture"],
            )

    rest = T._parse_datatype_string("lang_pred string, score double, mixture array<struct<lang:string,share:double>>")
    return in_tasks(chosen, predict, T.StructType([chosen.schema["id"], *rest]))


def learning_rows(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return docs.where(~held_out(id_column))


def keep_identified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Rows of `docs` in which a language is found, learned from the labelled rows; texts without a letter go, NULL ones too.

    Where no row has a label nothing can be learned, and every text with a letter stays. All columns come along; rows that
    repeat or lack an id are judged each by its own text; no documents give no rows. The rows themselves are not shuffled,
    only the few that `learn` learns from.
    """
    model = learn(learning_rows(docs, id_column), id_column, text_column, **options)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in sliced(batches, at):
            found = [bool(model.mixture(t.as_py()) if model.languages else len(trigrams(t.as_py()))) for t in batch.column(at)]
            yield batch.filter(pa.array(found, pa.bool_()))

    return in_tasks(docs, keep, docs.schema)
