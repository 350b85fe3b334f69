"""Calendar expressions: half-year periods, month edges, labels and ages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half-year numbering and its labels.
PERIOD_BASE_YEAR = 2024
PERIOD_LABEL_OFFSET = 36
LABEL_NO_DATE = "請求日未入力"
LABEL_CURRENT = "今期"
LABEL_PREVIOUS = "前期"
LABEL_SUFFIX = "期"
MONTH_SUFFIX = "月"


def as_date(value: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def half_year_index(date: Column) -> Column:
    """0 for the first half of the base year, counting up by one per half-year."""
    return ((F.year(date) - PERIOD_BASE_YEAR) * 2 + F.floor((F.month(date) - 1) / 6)).cast("int")


def half_year_of(day: dt.date) -> int:
    return (day.year - PERIOD_BASE_YEAR) * 2 + (day.month - 1) // 6


def period_label(date: Column, ref_date: dt.date | str) -> Column:
    """Half-year bucket seen from ref_date: current, previous, numbered, or "no date"."""
    now = half_year_of(as_date(ref_date))
    index = half_year_index(date)
    number = (index + PERIOD_LABEL_OFFSET).cast("double").cast("string")
    return (
        F.when(date.isNull(), LABEL_NO_DATE)
        .when(index == now, LABEL_CURRENT)
        .when(index == now - 1, LABEL_PREVIOUS)
        .otherwise(F.concat(number, F.lit(LABEL_SUFFIX)))
    )


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def month_end(month_first: Column) -> Column:
    return F.last_day(month_first)


def month_label(date: Column) -> Column:
    return F.concat(F.month(date).cast("string"), F.lit(MONTH_SUFFIX))


def year_month_text(year: Column, month: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def hours_between(earlier: Column, later: Column) -> Column:
    """Whole hours, truncated."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.call_function("div", micros, F.lit(3_600_000_000).cast("bigint"))


def clock_text(ts: Column, zone: str, suffix: str) -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm"), F.lit(suffix))
