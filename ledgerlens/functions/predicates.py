"""Filters as Column predicates; user text is always a literal, never spliced into SQL."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# State words used by the monitoring rules.
DISABLED = "DISABLED"
FAILED = "FAILED"
ERROR = "ERROR"


def all_of(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def where_all(df: DataFrame, predicates: Iterable[Column]) -> DataFrame:
    """Filter by the given predicates only; with none the plan stays untouched."""
    preds = list(predicates)
    return df.filter(all_of(preds)) if preds else df


def contains_ci(col: Column, text: str) -> Column:
    """Case-insensitive "contains"; `%`, `_` and `\\` in the text stand for themselves."""
    return F.contains(F.lower(col), F.lower(F.lit(text.strip())))


def equals_ci(col: Column, text: str) -> Column:
    return F.lower(col) == F.lower(F.lit(text.strip()))


def search(col_contains: dict[str, str], col_equals: dict[str, str]) -> list[Column]:
    """Optional text filters; a blank value means "not asked for"."""
    out = [contains_ci(F.col(c), v) for c, v in col_contains.items() if v and v.strip()]
    return out + [equals_ci(F.col(c), v) for c, v in col_equals.items() if v and v.strip()]


def keep_unless_like(col: Column, *patterns: str) -> Column:
    """Rows matching none of the LIKE patterns; NULL is kept."""
    return all_of((~col.like(p)) | col.isNull() for p in patterns)


def one_of(col: Column, values: Iterable[str], not_null: Column) -> Column:
    return col.isin(list(values)) & not_null.isNotNull()


def on_or_after_or_undated(date: Column, floor) -> Column:
    return (date >= F.lit(floor).cast("date")) | date.isNull()


def _upper(col: Column) -> Column:
    return F.upper(F.coalesce(col, F.lit("")))


def failed_by_prefix(execution: Column, status: Column, status_may_fail: bool = False) -> Column:
    """Alert rule: state words are prefixes; FAILED as a status counts for dataflows only."""
    ex, st = _upper(execution), _upper(status)
    bad = ex.startswith(FAILED) | ex.startswith(ERROR) | st.startswith(ERROR)
    if status_may_fail:
        bad = bad | st.startswith(FAILED)
    return ~st.startswith(DISABLED) & bad


def failed_by_word(execution: Column, status: Column) -> Column:
    """Health rule: state words anywhere; disabled only when the status is exactly that word."""
    ex, st = _upper(execution), _upper(status)
    bad = ex.contains(FAILED) | ex.contains(ERROR) | st.contains(FAILED) | st.contains(ERROR)
    return (st != DISABLED) & bad


def low_usage(views: Column, max_views: int) -> Column:
    return (views <= max_views) | views.isNull()


def at_least(col: Column, minimum: int, null_is_zero: bool) -> list[Column]:
    """Threshold active only when positive; NULL is 0 in health checks and drops in listings."""
    if minimum <= 0:
        return []
    return [(F.coalesce(col, F.lit(0)) if null_is_zero else col) >= minimum]


def card_count_direction(col: Column, direction: str | None, value: int) -> list[Column]:
    if not direction:
        return []
    count = F.coalesce(col, F.lit(0))
    return [count >= value if direction == "gte" else count < value]


def severity(state: Column) -> Column:
    """Failed first, then stale, then the rest."""
    s = F.coalesce(state, F.lit(""))
    failed = F.upper(s).contains(FAILED) | (s == ERROR)
    return F.when(failed, 0).when(s == "stale", 1).otherwise(2)


def severity_exact(state: Column) -> Column:
    """The stricter variant used for dataflow lists: whole words only."""
    s = F.coalesce(state, F.lit(""))
    return F.when(s.isin(FAILED, ERROR, "failed"), 0).when(s == "stale", 1).otherwise(2)
