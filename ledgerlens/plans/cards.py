"""Report cards over the stored table: year-over-year, yearly pivot, summary, profile, browsing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.periods import as_date, month_label
from ledgerlens.functions.predicates import where_all
from ledgerlens.operators.aggregates import column_profile, count_by, filter_values
from ledgerlens.operators.ordering import Order, page
from ledgerlens.operators.reshape import few_values, pivot_sum
from ledgerlens.plans.revenue import CATEGORY_BUDGET, CATEGORY_TASKS

# Columns offered as card filters, and the largest list of values shown.
FILTER_COLUMNS = ("BLカテゴリ", "ステータス名", "ERAWANコード", "プロジェクト名",
                  "カテゴリ", "担当者種別", "種", "請求日（期）")
MAX_FILTER_VALUES = 200


@dataclass(frozen=True)
class CardColumns:
    """Which columns of a table play which part in the cards."""

    category: str = "BLカテゴリ"
    status: str = "ステータス名"
    code: str = "ERAWANコード"
    project: str = "プロジェクト名"
    date: str = "請求日"
    amount: str = "税抜費用（int）"
    title: str = "課題タイトル"
    year: str = "請求年"
    month: str = "請求月"
    default_category: str | None = CATEGORY_TASKS


def card_filters(
    cols: CardColumns, category: str | None = None, status: str | None = None,
    code: str | None = None, project: str | None = None,
) -> list[Column]:
    """Equality filters that were asked for; a given category replaces the default one."""
    chosen = [(cols.category, category or cols.default_category), (cols.status, status),
              (cols.code, code), (cols.project, project)]
    return [F.col(f"`{c}`") == F.lit(v) for c, v in chosen if v]


def yoy(
    df: DataFrame, as_of: dt.date | str, cols: CardColumns = CardColumns(),
    filters: Sequence[Column] = (),
) -> DataFrame:
    """This year's and last year's amount per calendar month, and their ratio.

    Months without a row in either year still show when the table has any row in that month.
    """
    year = as_date(as_of).year
    date, amount = F.col(f"`{cols.date}`"), F.col(f"`{cols.amount}`")
    base = where_all(df, [*filters, date.isNotNull()])
    months = base.groupBy(F.month(date).alias("m")).agg(
        F.sum(F.when(F.year(date) == year, amount)).alias("__cur"),
        F.sum(F.when(F.year(date) == year - 1, amount)).alias("__prev"),
    )
    return months.select(
        F.col("m").cast("bigint").alias("m"),
        F.concat(F.col("m").cast("string"), F.lit("月")).alias("month"),
        F.coalesce("__cur", F.lit(0)).alias("current_year"),
        F.coalesce("__prev", F.lit(0)).alias("prev_year"),
        F.when(F.col("__prev") > 0, F.round(F.col("__cur").cast("double") / F.col("__prev"), 4))
        .alias("yoy_ratio"),
    ).orderBy("m")


def yoy_totals(rows: DataFrame) -> DataFrame:
    total = rows.agg(
        F.coalesce(F.sum("current_year"), F.lit(0)).alias("current_year"),
        F.coalesce(F.sum("prev_year"), F.lit(0)).alias("prev_year"),
    )
    ratio = F.round(F.col("current_year").cast("double") / F.col("prev_year"), 4)
    return total.withColumn("yoy_ratio", F.when(F.col("prev_year") > 0, ratio))


def revenue_by_year(
    df: DataFrame, cols: CardColumns = CardColumns(), filters: Sequence[Column] = (),
    years: Sequence[int] | None = None,
) -> tuple[DataFrame, list[int]]:
    """Amount per calendar month, one column per year, coded rows only."""
    date, code = F.col(f"`{cols.date}`"), F.col(f"`{cols.code}`")
    base = where_all(df, [*filters, code.isNotNull(), code != "", date.isNotNull()])
    flat = base.select(
        F.month(date).cast("bigint").alias("m"), month_label(date).alias("month"),
        F.year(date).alias("year"), F.col(f"`{cols.amount}`").alias("amount"),
    )
    grouped = flat.groupBy("m", "month", "year").agg(F.sum("amount").alias("amount"))
    return pivot_sum(grouped, ["m", "month"], "year", "amount", years)


def year_totals(pivot: DataFrame, years: Sequence[int]) -> DataFrame:
    return pivot.agg(*[F.coalesce(F.sum(f"`{y}`"), F.lit(0)).alias(str(y)) for y in years])


def summary(df: DataFrame, cols: CardColumns = CardColumns()) -> dict[str, DataFrame]:
    """Rows per category, top codes, statuses, monthly amounts and the budget rows."""
    tasks = df.filter(F.col(f"`{cols.category}`") == CATEGORY_TASKS)
    year, month = F.col(f"`{cols.year}`"), F.col(f"`{cols.month}`")
    budget = df.filter(F.col(f"`{cols.category}`") == CATEGORY_BUDGET)
    return {
        "categories": count_by(df, cols.category),
        "top_codes": count_by(tasks, cols.code, k=10),
        "statuses": count_by(tasks, cols.status),
        "monthly": monthly_amounts(tasks, year, month, F.col(f"`{cols.amount}`")),
        "budget": budget.select("カテゴリ", "請求月", "売上予算額", "累計売上予算額")
        .orderBy("カテゴリ", "請求月"),
    }


def monthly_amounts(tasks: DataFrame, year: Column, month: Column, amount: Column) -> DataFrame:
    return (
        tasks.filter(year.isNotNull())
        .groupBy(year.cast("bigint").alias("year"), month.cast("bigint").alias("month"))
        .agg(F.count(F.lit(1)).alias("count"), F.sum(amount.cast("double")).alias("revenue"))
        .orderBy("year", F.col("month").asc_nulls_last())
    )


def dataset_detail(df: DataFrame, samples: int = 3, order: Sequence[Column] | None = None) -> DataFrame:
    return column_profile(df, samples, order)


def card_filter_values(df: DataFrame, columns: Sequence[str] = FILTER_COLUMNS) -> DataFrame:
    return filter_values(df, columns, MAX_FILTER_VALUES)


def explore(
    df: DataFrame, order: Sequence[Order], number: int = 1, size: int = 100,
    category: str | None = None, text: str | None = None, cols: CardColumns = CardColumns(),
) -> tuple[DataFrame, DataFrame]:
    """One page of the filtered table, and the total number of filtered rows."""
    wanted = []
    if category:
        wanted.append(F.col(f"`{cols.category}`") == category)
    if text:
        wanted.append(F.col(f"`{cols.title}`").contains(text))
    hits = where_all(df, wanted)
    return page(hits, order, number, size), hits.agg(F.count(F.lit(1)).alias("total_rows"))


AGGREGATIONS = {"SUM": F.sum, "COUNT": F.count, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


@dataclass(frozen=True)
class CardSpec:
    """A card described by columns: rows, a measure, its aggregation, and optionally a pivot.

    A filter maps a column to a value, to None for rows without one, or to a pair of a comparison of
    COMPARISONS and its value.
    """

    row: str | None
    value: str
    aggregation: str = "SUM"
    pivot: str | None = None
    filters: Mapping[str, object] | None = None
    sort: str = "DESC"
    limit: int | None = None


def validate_card(spec: CardSpec, df: DataFrame) -> list[str]:
    """Problems of a card against a table's columns; an empty list means it can be built."""
    types = dict(df.dtypes)
    used = [spec.row, spec.pivot, *(spec.filters or {})]
    if spec.value != "*":
        used.append(spec.value)
    problems = [f"unknown column: {c}" for c in used if c and c not in types]
    kind = spec.aggregation.upper()
    if kind not in AGGREGATIONS:
        problems.append(f"unknown aggregation: {spec.aggregation}")
    elif spec.value == "*" and kind != "COUNT":
        problems.append(f"{kind} needs a value column")
    elif kind in ("SUM", "AVG") and types.get(spec.value) in ("string", "date", "boolean"):
        problems.append(f"{kind} needs a numeric column, not {spec.value}")
    unknown = [g[0] for g in (spec.filters or {}).values() if isinstance(g, tuple) and g[0] not in COMPARISONS]
    return problems + [f"unknown comparison: {c}" for c in unknown]


COMPARISONS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "contains": lambda c, v: c.cast("string").contains(v),
    "in": lambda c, v: c.isin(list(v)),
    "between": lambda c, v: c.between(v[0], v[1]),
}


def _hits(df: DataFrame, spec: CardSpec) -> DataFrame:
    """Rows that pass all filters: a value, None for no value, or a pair of comparison and value."""
    wanted = []
    for name, given in (spec.filters or {}).items():
        column = F.col(f"`{name}`")
        how, value = given if isinstance(given, tuple) else ("=", given)
        wanted.append(column.isNull() if value is None else COMPARISONS[how](column, value))
    return where_all(df, wanted)


def _measured(spec: CardSpec) -> Column:
    measure = F.lit(1) if spec.value == "*" else F.col(f"`{spec.value}`")
    return AGGREGATIONS[spec.aggregation.upper()](measure)


def _by_value(spec: CardSpec, value: Column) -> Column:
    return value.asc_nulls_last() if spec.sort.upper() == "ASC" else value.desc_nulls_last()


def card_cells(df: DataFrame, spec: CardSpec) -> DataFrame:
    """A card in long form: (kind, row, header, value), however many headers there are.

    kind tells cells from totals: cell, row (of all headers), header (of all rows), all. So a row
    or header without a value stays apart from the totals, and from the text null. All four come
    from one pass over the rows.
    """
    if problems := validate_card(spec, df):
        raise ValueError("; ".join(problems))
    if spec.row is None or spec.pivot is None:
        raise ValueError("a long card needs a row and a pivot")
    named = _hits(df, spec).withColumns({"__row": F.col(f"`{spec.row}`"), "__header": F.col(f"`{spec.pivot}`")})
    row, header = F.col("__row"), F.col("__header")
    grouped = named.groupingSets([[row, header], [row], [header], []], row, header).agg(
        _measured(spec).alias("value"), F.grouping_id().alias("__id"))
    kind = F.when(F.col("__id") == 0, "cell").when(F.col("__id") == 1, "row").when(
        F.col("__id") == 2, "header").otherwise("all")
    return grouped.select(kind.alias("kind"), row.alias("row"), header.alias("header"), "value")


def build_card(df: DataFrame, spec: CardSpec, headers: Sequence | None = None) -> DataFrame:
    """The card as a table: one row per row value, or a single value; with a pivot one column per header.

    Rows are ordered by their value, with a pivot by that over all headers. Headers are few: found
    first if not given, else card_cells has the long form. Rows without a pivot value have a column
    of their own, last if found; its name is null, or (null) beside a header of that text.
    """
    if problems := validate_card(spec, df):
        raise ValueError("; ".join(problems))
    hits, value = _hits(df, spec), _measured(spec)
    if spec.row is None:
        return hits.agg(value.alias("value"))
    row = F.col(f"`{spec.row}`")
    if spec.pivot is None:
        out = hits.groupBy(row).agg(value.alias("value")).orderBy(
            _by_value(spec, F.col("value")), row.asc_nulls_last())
        return out if spec.limit is None else out.limit(spec.limit)
    if headers is None:
        headers = few_values(hits, spec.pivot)
        if not hits.filter(F.col(f"`{spec.pivot}`").isNull()).isEmpty():
            headers = [*headers, None]
    texts = [h for h in headers if h is not None]
    labels = hits.sparkSession.range(1).select(
        F.lit(0).alias("__"), *[F.lit(h).cast("string") for h in texts]).first()[1:]
    empty = "(null)" if "null" in map(str.lower, labels) else "null"
    names = dict(zip(texts, labels))
    cells = card_cells(df, spec).filter(F.col("kind").isin("cell", "row"))
    wanted = lambda h: (F.col("kind") == "cell") & F.col("header").eqNullSafe(F.lit(h))
    # Cells are found by their header, null-safe, and not by its name; each is one row by now.
    wide = cells.groupBy(F.col("row").alias(spec.row)).agg(
        F.max(F.when(F.col("kind") == "row", F.col("value"))).alias("__all"),
        *[F.max(F.when(wanted(h), F.col("value"))).alias(empty if h is None else names[h]) for h in headers])
    out = wide.orderBy(_by_value(spec, F.col("__all")), row.asc_nulls_last()).drop("__all")
    return out if spec.limit is None else out.limit(spec.limit)
