"""Day numbers (YYYYMMDD integers) and dates."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, functions as F


def day_number(day: date) -> int:
    return day.year * 10000 + day.month * 100 + day.day


def number_day(number: int) -> date:
    return date(number // 10000, number // 100 % 100, number % 100)


def day_number_col(day: Column) -> Column:
    return (F.year(day) * 10000 + F.month(day) * 100 + F.day(day)).cast("int")


def number_day_col(number: Column) -> Column:
    """Date of a YYYYMMDD number, NULL where it is no date."""
    return F.try_to_date(number.cast("string"), "yyyyMMdd")


def clamp_window(
    newest: date, coverage_days: int, start: date | None, end: date | None
) -> tuple[date, date]:
    """Fit a requested range into the days that are present, oldest bound first."""
    oldest = newest - timedelta(days=max(1, coverage_days) - 1)
    fitted = [min(max(day, oldest), newest) for day in (start or oldest, end or newest)]
    return min(fitted), max(fitted)


def clamp_window_cols(
    newest: Column, coverage_days: Column, start: Column, end: Column
) -> tuple[Column, Column]:
    """`clamp_window` for columns; NULL bounds mean the whole coverage."""
    oldest = F.date_sub(newest, (F.greatest(F.lit(1), coverage_days) - 1).cast("int"))
    lo = F.least(F.greatest(F.coalesce(start, oldest), oldest), newest)
    hi = F.least(F.greatest(F.coalesce(end, newest), oldest), newest)
    return F.least(lo, hi), F.greatest(lo, hi)
