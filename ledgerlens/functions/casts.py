"""Forgiving text casts: anything that does not parse becomes NULL instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Epoch numbers above this are milliseconds, others seconds (fixed value).
EPOCH_MILLIS_ABOVE = 10_000_000_000

# White space in text: everything Unicode calls so, and the four separator controls (fixed value).
SPACE = r"\s\x1c-\x1f"

# Year, month and day, and a time of day or nothing (fixed value).
DATE_TEXT = (
    r"^\s*(\d{1,6}-\d{1,2}-\d{1,2})"
    r"(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:[+-]\d{2}(?::?\d{2})?)?)?\s*\z")


def try_date(text: Column) -> Column:
    """Text to DATE: year-month-day with `-` or `/`, and a time of day or nothing after it."""
    iso = F.replace(text.cast("string"), F.lit("/"), F.lit("-"))
    day = F.regexp_extract(iso, DATE_TEXT, 1)
    return F.when(day != "", day.try_cast("date"))


def try_bigint(text: Column) -> Column:
    """Text to BIGINT: whole numbers exactly, decimals and exponents rounded half away from zero.

    Single underscores between digits are skipped, and 0x and 0b begin other bases. Only ASCII
    digits count.
    """
    s = F.when(text.cast("string").rlike(r"^[\x00-\x7f]*\z"), text.cast("string"))
    s = F.regexp_replace(s, r"(?<=[0-9])_(?=[0-9])", "")
    rounded = F.round(s.try_cast("decimal(38,6)")).try_cast("bigint")
    number = F.coalesce(s.try_cast("bigint"), rounded)
    for prefix, digit, base in (("0[xX]", "[0-9a-fA-F]{1,15}", 16), ("0[bB]", "[01]{1,62}", 2)):
        other = F.regexp_extract(s, rf"^\s*{prefix}({digit})\s*\z", 1)
        number = F.when(other != "", F.conv(other, base, 10).try_cast("bigint")).otherwise(number)
    return number


def joined(*parts: Column) -> Column:
    """Concatenation that skips NULL parts."""
    return F.concat_ws("", *parts)


def digits(text: Column) -> Column:
    """Only the ASCII digits of the text."""
    return F.regexp_replace(text.cast("string"), r"[^0-9]", "")


def has_digits(text: Column) -> Column:
    return text.isNotNull() & (digits(text) != "")


def parse_year_month(text: Column) -> Column:
    """`2024年07月`, `202407`, `2024/07` ... to the first day of that month, else NULL."""
    d = digits(text)
    return try_date(F.concat(F.left(d, F.lit(4)), F.lit("-"), F.right(d, F.lit(2)), F.lit("-01")))


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """DATE from text or number parts, NULL when they name no day."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return try_date(joined(year.cast("string"), F.lit("-"), two(month), F.lit("-"), two(day)))


def epoch_timestamp(epoch: Column) -> Column:
    """Epoch seconds or milliseconds, told apart by size, to TIMESTAMP; 0 and NULL give NULL."""
    n = epoch.cast("bigint")
    millis = F.timestamp_millis(n)
    seconds = F.timestamp_seconds(n)
    return F.when(n.isNull() | (n == 0), None).when(n > EPOCH_MILLIS_ABOVE, millis).otherwise(seconds)


def strip_space(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, rf"(?U)\A[{SPACE}]+|[{SPACE}]+\z", "")


def squeeze_space(text: Column) -> Column:
    """Every run of white space to one blank, none at the ends; single blanks need no rewriting."""
    return F.trim(F.regexp_replace(text, rf"(?U)[{SPACE}]{{2,}}|[{SPACE}&&[^ ]]", " "))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def blank_to(text: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(text), F.lit(default))
