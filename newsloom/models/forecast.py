"""Daily forecasts per country and their walk-forward backtest."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from newsloom.operators.trends import country_conflict_daily, daily_series, top_countries
from newsloom.plans.filters import days_between, in_country

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEEKLY_FROM_DAYS = 7
YEARLY_FROM_DAYS = 365
YEARLY_WAVES = 3
# Normal quantile of a two-sided 80% band.
BAND_80 = 1.2815515655446004

TRAIN_DAYS = 14
TEST_DAYS = 7
#: Price of a further segment of the trend, and its least number of days.
KNOT_PENALTY, KNOT_DAYS = 6.0, 7
#: A forecast's trend is one line, bends where the data say so, or on given days.
Bends = bool | Sequence[date]

FORECAST_TYPE = (
    "country_code string, date date, predicted_count double, lower_bound double, "
    "upper_bound double, model_type string, horizon_days int, training_days int, "
    "total_historical_events bigint"
)


def without_week(days: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts less the usual distance of their weekday from the seven days around them; the median passes over the days at bends."""
    if len(days) < 2 * WEEKLY_FROM_DAYS:
        return counts
    around = np.convolve(counts, np.full(WEEKLY_FROM_DAYS, 1 / WEEKLY_FROM_DAYS), "valid")
    inner = slice(WEEKLY_FROM_DAYS // 2, WEEKLY_FROM_DAYS // 2 + len(around))
    weekday, away = days[inner] % 7, counts[inner] - around
    usual = {w: np.median(away[weekday == w]) for w in np.unique(weekday)}
    return counts - np.array([usual.get(w, 0.0) for w in days % 7])


def line_errors(days: np.ndarray, counts: np.ndarray):
    """Function (starts, end): squared error of the best line through the points from each start up to `end`, without it."""
    t = days - days.mean()
    y = counts - counts.mean()
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (np.ones(len(t)), t, y, t * t, t * y, y * y)]

    def errors(starts: np.ndarray, end: int) -> np.ndarray:
        n, st, sy, stt, sty, syy = (total[end] - total[starts] for total in sums)
        vt, vy, cov = stt - st * st / n, syy - sy * sy / n, sty - st * sy / n
        return np.maximum(vy - np.where(vt > 0, cov * cov / np.where(vt > 0, vt, 1.0), 0.0), 0.0)

    return errors


def find_knots(days: np.ndarray, counts: np.ndarray, penalty: float = KNOT_PENALTY, least: int = KNOT_DAYS) -> list[float]:
    """Days on which the trend bends, in order; none for a straight one.

    Segments of at least `least` points are chosen by dynamic programming over all ends: their lines' squared errors plus, for
    each segment, `penalty` times the logarithm of the number of days times the noise, which is that of second differences.
    Their borders are then moved, one day at a time, to where the line that bends in them fits best.
    """
    if len(days) < 2 * least:
        return []
    flat = without_week(days, counts)
    noise = (np.median(np.abs(np.diff(flat, 2))) / 0.6745) ** 2 / 6
    price = penalty * np.log(len(days)) * max(noise, 1e-6 * flat.var(), 1e-12)
    errors = line_errors(days, flat)
    best, before = np.full(len(days) + 1, np.inf), np.zeros(len(days) + 1, int)
    best[0] = 0.0
    for end in range(least, len(days) + 1):
        starts = np.arange(0, end - least + 1)
        total = best[starts] + errors(starts, end) + price
        before[end] = starts[total.argmin()]
        best[end] = total.min()
    borders, at = [], before[len(days)]
    while at > 0:
        borders.append(at)
        at = before[at]
    knots = sorted(float(days[at]) for at in borders)

    def misfit(chosen: list[float]) -> float:
        known = np.column_stack([np.ones(len(days)), days - days[0], *(np.maximum(days - k, 0.0) for k in chosen)])
        return float(((flat - known @ np.linalg.lstsq(known, flat, rcond=None)[0]) ** 2).sum())

    moved = True
    while moved:
        moved = False
        for k in range(len(knots)):
            for step in (-1.0, 1.0):
                tried = [*knots[:k], knots[k] + step, *knots[k + 1 :]]
                apart = np.diff([days[0], *tried, days[-1]])
                if apart.min() >= 1.0 and misfit(tried) < misfit(knots) * (1 - 1e-9):
                    knots, moved = tried, True
    return knots


def fit_days(days: np.ndarray, counts: np.ndarray, ahead: np.ndarray, knots: Sequence[float] = ()):
    """Least-squares forecast for day numbers `ahead`: values, half band width, model name.

    One trend, which bends on the days `knots`, and a level per weekday; a single level below seven days or where no
    weekday occurs twice. A weekday that was never seen gets the mean level. A year of
    days adds yearly waves.
    """
    weekly = len(days) >= WEEKLY_FROM_DAYS and len(days) > len(np.unique(days % 7))
    yearly = len(days) >= YEARLY_FROM_DAYS
    levels = np.unique(days % 7) if weekly else np.zeros(1)

    def design(at: np.ndarray) -> np.ndarray:
        level = (at % 7 if weekly else np.zeros(len(at)))[:, None] == levels[None, :]
        level = np.where(level.any(axis=1, keepdims=True), level, 1.0 / len(levels))
        waves = []
        if yearly:
            angles = 2 * np.pi * at / 365.25
            waves = [f(w * angles) for w in range(1, YEARLY_WAVES + 1) for f in (np.sin, np.cos)]
        bends = [np.maximum(at - knot, 0.0) for knot in knots]
        return np.column_stack([at - days[0], level, *bends, *waves])

    known = design(days)
    weights, _, rank, _ = np.linalg.lstsq(known, counts, rcond=None)
    spread = np.sqrt(np.sum((counts - known @ weights) ** 2) / max(1, len(days) - rank))
    name = "trend" + ("_bent" if len(knots) else "") + ("_weekly" if weekly else "") + ("_yearly" if yearly else "")
    return design(ahead) @ weights, BAND_80 * spread, name


def _day_numbers(dates: pd.Series) -> np.ndarray:
    return (pd.to_datetime(dates) - pd.Timestamp("1970-01-01")).dt.days.to_numpy(float)


def _knots(bends: Bends, days: np.ndarray, counts: np.ndarray) -> list[float]:
    if isinstance(bends, bool):
        return find_knots(days, counts) if bends else []
    given = sorted(float((day - date(1970, 1, 1)).days) for day in bends)
    return [day for day in given if days[0] < day < days[-1]]


def trend_changes(series: DataFrame) -> DataFrame:
    """One row (country_code, date, before, after) per bend of a country's trend: events a day that it rises by before and after."""

    def changes(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        days, counts = _day_numbers(group["date"]), group["count"].to_numpy(float)
        knots = find_knots(days, counts)
        known = np.column_stack([np.ones(len(days)), days, *(np.maximum(days - k, 0.0) for k in knots)])
        slopes = np.cumsum(np.linalg.lstsq(known, without_week(days, counts), rcond=None)[0][1:])
        return pd.DataFrame({
            "country_code": pd.Series([group["country_code"].iloc[0]] * len(knots), dtype=object),
            "date": pd.Series([date(1970, 1, 1) + timedelta(days=int(k)) for k in knots], dtype=object),
            "before": slopes[:-1], "after": slopes[1:],
        })

    shape = "country_code string, date date, before double, after double"
    return series.select("country_code", "date", "count").groupBy("country_code").applyInPandas(changes, shape)


def forecast(series: DataFrame, horizon_days: int = 7, bends: Bends = False) -> DataFrame:
    """Forecast of series(country_code, date, count), one fit per country.

    `bends` lets the trend bend: True where `find_knots` says so, or on the days that are given.

    A group holds one row per day, so its size is that of the calendar and not of the
    event table. Fewer than two days give the last count as a flat line. Values and
    bounds do not fall below 0.
    """
    horizon = max(1, horizon_days)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        days, counts = _day_numbers(group["date"]), group["count"].to_numpy(float)
        ahead = days[-1] + np.arange(1, horizon + 1)
        if len(days) < 2:
            value, band, kind = np.full(horizon, counts[-1]), 0.0, "naive_fallback"
        else:
            value, band, kind = fit_days(days, counts, ahead, _knots(bends, days, counts))
        return pd.DataFrame(
            {
                "country_code": group["country_code"].iloc[0],
                "date": (pd.Timestamp("1970-01-01") + pd.to_timedelta(ahead, unit="D")).date,
                "predicted_count": np.maximum(value, 0.0),
                "lower_bound": np.maximum(value - band, 0.0),
                "upper_bound": np.maximum(value + band, 0.0),
                "model_type": kind,
                "horizon_days": horizon,
                "training_days": len(days),
                "total_historical_events": int(counts.sum()),
            }
        )

    daily = series.select("country_code", "date", "count")
    return daily.groupBy("country_code").applyInPandas(fit, FORECAST_TYPE)


def forecast_country(
    events: DataFrame,
    country_code: str | None,
    horizon_days: int = 7,
    training_days: int = 90,
    anchor: date | None = None,
    bends: Bends = False,
) -> DataFrame:
    """Forecast of all events of a country, or of the world when no code is given."""
    rows = events.where(days_between(events, -training_days, 1, anchor))
    if country_code is not None:
        rows = rows.where(in_country(country_code))
    code = F.lit(country_code.upper() if country_code else None).cast("string")
    return forecast(daily_series(rows).withColumn("country_code", code), horizon_days, bends)


def forecast_countries(
    events: DataFrame,
    countries: int = 50,
    training_days: int = 90,
    horizon_days: int = 30,
    anchor: date | None = None,
    conflict_only: bool = True,
    bends: Bends = False,
) -> DataFrame:
    """Nightly form: conflict forecasts of the busiest countries as one job."""
    busiest = top_countries(events, training_days, countries, anchor).select("country_code")
    series = country_conflict_daily(events, training_days, anchor, conflict_only)
    return forecast(series.join(busiest, "country_code", "left_semi"), horizon_days, bends)


# --- backtest -------------------------------------------------------------------

FOLD_TYPE = "country_code string, cut int, at int, predicted double, band double, naive double"


def backtest(
    series: DataFrame, train_days: int = TRAIN_DAYS, test_days: int = TEST_DAYS, bends: Bends = False
) -> DataFrame:
    """Walk-forward errors of series(country_code, date, count) per country.

    Every cut after `train_days` days trains on the days before it and predicts the next
    `test_days`. Days are handed to their cuts by exploding the range of cuts they belong
    to, so no join of all days with all cuts is needed.
    """
    by_day = Window.partitionBy("country_code").orderBy("date")
    whole = Window.partitionBy("country_code")
    days = series.select("country_code", "date", F.col("count").cast("double").alias("y")).select(
        "*",
        (F.row_number().over(by_day) - 1).alias("at"),
        F.count("*").over(whole).cast("int").alias("n"),
    )
    last_cut = F.col("n") - test_days - 1

    def cuts(low, high):
        return F.explode(F.sequence(low, high))

    first_cut = F.greatest(F.lit(train_days), F.col("at") + 1)
    training = days.where(first_cut <= last_cut).select(
        "country_code", "date", "y", "at", cuts(first_cut, last_cut).alias("cut")
    )
    low = F.greatest(F.lit(train_days), F.col("at") - (test_days - 1))
    high = F.least(last_cut, F.col("at"))
    actual = days.where(low <= high).select("country_code", "y", "at", cuts(low, high).alias("cut"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        numbers, counts = _day_numbers(group["date"]), group["y"].to_numpy(float)
        ahead = numbers[-1] + np.arange(1, test_days + 1)
        value, band, _ = fit_days(numbers, counts, ahead, _knots(bends, numbers, counts))
        cut = int(group["cut"].iloc[0])
        return pd.DataFrame(
            {
                "country_code": group["country_code"].iloc[0],
                "cut": cut,
                "at": cut + np.arange(test_days),
                "predicted": value,
                "band": band,
                "naive": counts[-1],
            }
        )

    predicted = training.groupBy("country_code", "cut").applyInPandas(fold, FOLD_TYPE)
    pairs = predicted.join(actual, ["country_code", "cut", "at"])
    value, y = F.greatest(F.col("predicted"), F.lit(0.0)), F.col("y")
    inside = y.between(F.col("predicted") - F.col("band"), F.col("predicted") + F.col("band"))
    errors = pairs.groupBy("country_code").agg(
        F.count_distinct("cut").alias("windows"),
        F.avg(F.abs(y - value)).alias("mae"),
        F.avg(F.abs(y - F.col("naive"))).alias("naive_mae"),
        F.avg(F.when(y != 0, F.abs(y - value) / y) * 100).alias("mape_pct"),
        F.avg(inside.cast("double") * 100).alias("band_coverage_pct"),
    )
    gain = F.when(
        F.col("naive_mae") > 0, (F.col("naive_mae") - F.col("mae")) / F.col("naive_mae") * 100
    ).otherwise(0.0)
    return errors.withColumn("improvement_pct", gain)
