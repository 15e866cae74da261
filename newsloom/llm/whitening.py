"""Whitened principal components by Chebyshev-filtered subspace iteration.

Vectors are put on a whole-number grid, so that counts, sums and squared deviations are exact. The covariance is never
formed: a block Q of directions is multiplied by it in passes over the vectors, V Q = D^T (D Q) / n with D the centred
rows. A Chebyshev polynomial, run by its recurrence over such passes, damps the spectrum below the block; QR and a
Rayleigh-Ritz step then give eigenvectors, until their residuals certify them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import acosh, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from newsloom.llm.shared import in_tasks, kept

COMPONENTS = 16
#: Grid: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Directions iterated for each that is asked for; the surplus makes the damped interval end well below the last one wanted.
SURPLUS = 2
#: Residual against the largest eigenvalue at which a pair is certified, the one accepted where rounding ends the progress, and rounds.
CLOSE, ROUNDED, ROUNDS = 1e-13, 1e-11, 100
#: Most that one filter lifts the first direction over the damped ones, and its most passes.
LIFT, DEGREE = 1e8, 12
#: An eigenvalue below this share of the largest is no direction of variation.
NO_VARIANCE = 1e-12
SEED = 13
#: Partial sums are one block a task; tasks read several files, so that there are this many a core at most.
TASKS_PER_CORE = 4


def grid(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, x) of the vectors whose components are all finite: x = floor(64 c) + 1000000 per component, as bigint.

    NULL and empty vectors, and those with a NULL or non-finite component, go; so do those with one beyond 2 ** 56, whose
    grid value is no bigint. Vectors are one space: of several lengths the most frequent stays, of equally frequent the longest.
    """
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 56)))
    sound = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~odd)
    lengths = sound.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if lengths is not None:
        sound = sound.where(F.size("vector") == lengths.length)
    return sound.select("id", F.transform("vector", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _block(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length as rows of bigints."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(fit: DataFrame, width: int, cells: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of `cells(block)` (a matrix `width` wide) over all rows of `fit`; a task sends one matrix, added up by its rows."""
    spark = fit.sparkSession
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = cells(_block(batch.column(0)))
                total = own if total is None else total + own
        if total is not None:
            lists = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), lists], ["at", "sums"])

    parts = in_tasks(fit.coalesce(tasks), add, "at int, sums array<double>")
    rows = parts.groupBy("at").agg(*(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width))).orderBy("at")
    return np.array([tuple(row)[1:] for row in rows.collect()], np.float64).reshape(-1, width)


@dataclass
class Centre:
    """Number of vectors and sum per dimension, exact, and the centring that follows from them."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.floor = np.array([total // self.n for total in self.sums], np.int64)
        self.over = [total - self.n * int(low) for total, low in zip(self.sums, self.floor)]
        self.rest = np.array([over / self.n for over in self.over])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; the whole part is taken off before anything is rounded."""
        return (x - self.floor) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S) ** 2 of each row, exact at any size."""
        away = x - self.floor
        most = int(np.abs(away).max(initial=0)) + 1
        if (self.n * most + self.n) ** 2 * x.shape[1] >= 1 << 62:
            away = away.astype(object)
        return (((away * self.n - np.array(self.over, away.dtype)) ** 2).sum(axis=1)).tolist()


def centre_of(fit: DataFrame, length: int) -> Centre:
    """Exact sums of the grid vectors `fit`; a task adds whole numbers without a bound and sends one per dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * length
        for batch in batches:
            block = _block(batch.column(0)) if batch.num_rows else np.zeros((0, length), np.int64)
            n += len(block)
            wide = block.astype(object) if len(block) and int(np.abs(block).max()) > (1 << 62) // len(block) else block
            sums = [known + int(new) for known, new in zip(sums, wide.sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(length + 1, dtype=np.int32)), pa.array([Decimal(v) for v in (*sums, n)], pa.decimal128(38, 0))], ["at", "n"]
            )

    rows = in_tasks(fit, add, "at int, n decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n")).collect()
    found = {row["at"]: int(row["n"]) for row in rows}
    return Centre(found[length], [found[at] for at in range(length)])


def filtered(block: np.ndarray, image: np.ndarray, ritz: np.ndarray, times: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """`block` through the Chebyshev polynomial that is small on [0, least Ritz value] and grows above; `image` is V times `block`.

    The recurrence is scaled by the largest Ritz value, so nothing overflows, and ends before the first direction outgrows
    the others by more than LIFT.
    """
    half = max(float(ritz[-1]), NO_VARIANCE * float(ritz[0])) / 2
    top = max(float(ritz[0]) / half - 1.0, 1.0 + 1e-9)
    degree = int(min(DEGREE, max(2, (log(2 * LIFT)) // acosh(top))))
    scale = 1.0 / top
    first, last, current = scale, block, (image - half * block) * (scale / half)
    for _ in range(degree - 1):
        following = 1.0 / (2.0 / first - scale)
        step = (times(current) - half * current) * (2.0 * following / half) - scale * following * last
        last, current, scale = current, step, following
    return current


@dataclass
class Fit:
    """Leading eigenvalues, falling, their unit eigenvectors as columns, the trace, and what it took to certify them."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def leading(fit: DataFrame, centre: Centre, wanted: int = COMPONENTS) -> Fit:
    """Leading `wanted` eigenpairs of the covariance of `fit` (divisor n), certified by their residuals.

    A pass sends each task the block, vector length x SURPLUS * wanted doubles, and gets as many back; both are bounded by
    the vectors' length, whatever their number. Pairs whose eigenvalue is zero are left out. Raises an error if
    the residuals stay above ROUNDED of the largest eigenvalue for ROUNDS rounds.
    """
    length, passes = len(centre.sums), 0
    size = min(length, SURPLUS * wanted)
    wanted = min(wanted, length)

    def pass_over(block: np.ndarray) -> np.ndarray:
        """V block, and below it a row that holds the trace."""

        def cells(x: np.ndarray) -> np.ndarray:
            rows = centre.centred(x)
            return np.vstack([rows.T @ (rows @ block), np.full((1, block.shape[1]), float((rows * rows).sum()))])

        nonlocal passes
        passes += 1
        return _summed(fit, block.shape[1], cells) / centre.n

    block = np.linalg.qr(np.random.default_rng(SEED).standard_normal((length, size)))[0]
    best = np.inf
    stuck = 0
    for _ in range(ROUNDS):
        found = pass_over(block)
        image, trace = found[:-1], float(found[-1, 0])
        small = block.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = np.maximum(ritz[::-1], 0.0), turn[:, ::-1]
        block, image = block @ turn, image @ turn
        left = np.linalg.norm(image[:, :wanted] - block[:, :wanted] * ritz[:wanted], axis=0)
        worst = float(left.max()) / ritz[0] if ritz[0] > 0 else 0.0
        # Rounding ends the progress of pairs that are as exact as they can get.
        stuck = stuck + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if worst <= CLOSE or (worst <= ROUNDED and stuck >= 2):
            real = int(np.count_nonzero(ritz[:wanted] > NO_VARIANCE * ritz[0])) if ritz[0] > 0 else 0
            return Fit(ritz[:real], block[:, :real], trace, left[:real], passes)
        block = np.linalg.qr(filtered(block, image, ritz, lambda q: pass_over(q)[:-1]))[0]
    raise ArithmeticError(f"residuals stay at {best} of the largest eigenvalue")


def whiten(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row (id, component, n, deviation, whitened, explained, identity_error) per usable row and component, from 1 on.

    The fit counts each distinct grid vector once, see `grid` for which rows are used. deviation is the exact sum over dimensions of
    (n x - S) ** 2, a decimal; whitened the row's projection on the component over the root of its eigenvalue; explained the
    eigenvalue over the trace; identity_error how far the covariance of the whitened fit is from the identity. Signs make each
    eigenvector's largest entry positive. There are as many components as dimensions in which the fit varies, at most
    `components`: a single distinct vector gives no rows, and neither does an empty table. Ids may be NULL or repeat, and
    equal rows come out as often as they came in; other columns are ignored.

    Vectors are shuffled once, equal ones combined before; passes read the written fit and move one block a task.
    """
    rows = grid(vectors, id_column, vector_column)
    shape = T.StructType([
        T.StructField("id", rows.schema["id"].dataType),
        *T._parse_datatype_string(
            "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
        ),
    ])
    fit = kept(rows.select("x").distinct())
    one = fit.first()
    if one is None:
        return vectors.sparkSession.createDataFrame([], shape)
    centre = centre_of(fit, len(one.x))
    found = leading(fit, centre, components)
    if not len(found.values):
        return vectors.sparkSession.createDataFrame([], shape)
    largest = np.abs(found.vectors).argmax(axis=0)
    project = found.vectors * np.sign(found.vectors[largest, np.arange(len(largest))]) / np.sqrt(found.values)

    def moments(x: np.ndarray) -> np.ndarray:
        values = centre.centred(x) @ project
        return np.vstack([values.T @ values, values.sum(axis=0, keepdims=True)])

    total = _summed(fit, project.shape[1], moments) / centre.n
    covariance = total[:-1] - np.outer(total[-1], total[-1])
    error = float(np.abs(covariance - np.eye(len(covariance))).max())
    number, explained = len(found.values), found.values / found.trace

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _block(batch.column(1))
            every = np.repeat(np.arange(len(x)), number)
            deviations = pa.array([Decimal(value) for value in centre.deviations(x)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(every)),
                    pa.array(np.tile(np.arange(1, number + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(every), centre.n)),
                    deviations.take(pa.array(every)),
                    pa.array((centre.centred(x) @ project).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(every), error)),
                ],
                shape.names,
            )

    return in_tasks(rows, apply, shape)
