"""Rows to columns and back: null-keeping unpivots, month expansion, pivots, links, list packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import BROADCAST_ROWS

# Most pivot headers that may go into a plan as constants.
MAX_HEADERS = 1_000


def unpivot_pairs(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]],
    label: str,
    value: str,
    weight_label: str,
    weight: str,
) -> DataFrame:
    """One row per (value column, weight column) pair, NULLs kept, in one pass over the input."""
    rows = F.array(
        *[
            F.struct(
                F.lit(v).alias(label),
                F.col(f"`{v}`").alias(value),
                F.lit(w).alias(weight_label),
                F.col(f"`{w}`").alias(weight),
            )
            for v, w in pairs
        ]
    )
    used = {c for pair in pairs for c in pair}
    rest = [F.col(f"`{c}`") for c in df.columns if c not in used]
    return df.select(*rest, F.inline(rows))


def unpivot_numbered(
    df: DataFrame, columns: Sequence[str], number: str, value: str
) -> DataFrame:
    """Columns to rows numbered 1..n (months), NULL values kept."""
    rest = [c for c in df.columns if c not in set(columns)]
    cells = [F.struct(F.lit(i).alias(number), F.col(f"`{c}`").alias(value))
             for i, c in enumerate(columns, 1)]
    return df.select(*[F.col(f"`{c}`") for c in rest], F.inline(F.array(*cells)))


def expand_months(
    df: DataFrame, start: Column, end: Column, calendar: DataFrame, date: str
) -> DataFrame:
    """Each row once per calendar month start with start <= month <= end.

    The span is clipped to the calendar and generated per row, then matched to the calendar by an
    equi-join; repeated calendar dates repeat the row, as a range join would.
    """
    calendar = calendar.filter(F.col(date).isNotNull())
    lo, hi, size = calendar.agg(F.min(date), F.max(date), F.count(F.lit(1))).first()
    bound = lambda d: F.lit(d).cast("date")
    next_month = F.trunc(F.date_add(start, -1), "month") + F.expr("INTERVAL 1 MONTH")
    spans = df.select(
        "*",
        F.greatest(next_month.cast("date"), bound(lo)).alias("__first"),
        F.least(end, bound(hi)).alias("__last"),
    ).filter(start.isNotNull() & end.isNotNull() & (F.col("__first") <= F.col("__last")))
    months = F.sequence("__first", "__last", F.expr("INTERVAL 1 MONTH"))
    rows = spans.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(months).alias(date))
    return rows.join(F.broadcast(calendar) if size <= BROADCAST_ROWS else calendar, date)


def few_values(df: DataFrame, column: str) -> list:
    """Sorted distinct values that become column headers; too many of them is an error."""
    distinct = df.select(column).distinct().limit(MAX_HEADERS + 1).collect()
    if len(distinct) > MAX_HEADERS:
        raise ValueError(f"{column} has more than {MAX_HEADERS} values to pivot on")
    return sorted((r[0] for r in distinct if r[0] is not None))


def pivot_sum(
    df: DataFrame, rows: Sequence[str], column: str, value: str, headers: Sequence | None = None
) -> tuple[DataFrame, list]:
    """Sums by row keys and header values, missing cells 0. Headers are few; found first if not given."""
    if headers is None:
        headers = few_values(df, column)
    wide = df.groupBy(*rows).pivot(column, list(headers)).agg(F.sum(value))
    cells = [F.coalesce(F.col(f"`{h}`"), F.lit(0)).alias(str(h)) for h in headers]
    return wide.select(*rows, *cells), list(headers)


def exploded_links(df: DataFrame, keys: Sequence[str], links: str, kind: str) -> DataFrame:
    """(keys, resource id) for every active link to a resource of the given kind."""
    link = F.explode(F.col(links)).alias("__link")
    return (
        df.select(*keys, link)
        .filter((F.col("__link.resource.type") == kind) & F.col("__link.active"))
        .select(*keys, F.col("__link.resource.id").alias("resource_id"))
    )


def link_ids(links: Column, kind: str) -> Column:
    """Ids of all linked resources of the given kind, as an array."""
    hits = F.filter(links, lambda x: x["resource"]["type"] == kind)
    return F.transform(hits, lambda x: x["resource"]["id"])


def edges(df: DataFrame, key: str, targets: Column, source_name: str, target_name: str) -> DataFrame:
    """Distinct (source, target) rows from an array of references."""
    return df.select(
        F.col(key).alias(source_name), F.explode(targets).alias(target_name)
    ).distinct()
