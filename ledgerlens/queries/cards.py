"""Report cards on the orders and part tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import asc
from ledgerlens.plans import cards
from ledgerlens.operators.aggregates import (
    column_profile, column_sketches, filter_values, merged_sketches,
)
from ledgerlens.queries.registry import ORDERS_DATED, REF_DATE, Tables, orders_dated, query

COLUMNS = cards.CardColumns(
    category="o_orderstatus", status="o_orderstatus", code="o_orderpriority", project="o_custkey",
    date="d", amount="cents", title="o_orderpriority", default_category=None)
Y = REF_DATE.year

YOY = f"""SELECT month(d) AS m, concat(month(d), '月') AS "month",
        CAST(coalesce(sum(CASE WHEN year(d) = {Y} THEN cents END), 0) AS BIGINT) AS current_year,
        CAST(coalesce(sum(CASE WHEN year(d) = {Y - 1} THEN cents END), 0) AS BIGINT) AS prev_year,
        CASE WHEN sum(CASE WHEN year(d) = {Y - 1} THEN cents END) > 0 THEN
            round(CAST(sum(CASE WHEN year(d) = {Y} THEN cents END) AS DOUBLE)
                / sum(CASE WHEN year(d) = {Y - 1} THEN cents END), 4) END AS yoy_ratio
    FROM {ORDERS_DATED} o WHERE o_orderstatus = 'F' GROUP BY 1, 2"""


@query("q_yoy", YOY)
def yoy(t: Tables) -> DataFrame:
    return cards.yoy(orders_dated(t), REF_DATE, COLUMNS, cards.card_filters(COLUMNS, category="F"))


@query("q_yoy_totals", f"""
    SELECT CAST(sum(current_year) AS BIGINT) AS current_year, CAST(sum(prev_year) AS BIGINT) AS prev_year,
        CASE WHEN sum(prev_year) > 0 THEN round(CAST(sum(current_year) AS DOUBLE) / sum(prev_year), 4) END AS yoy_ratio
    FROM ({YOY})
""")
def yoy_totals(t: Tables) -> DataFrame:
    return cards.yoy_totals(yoy(t))


@query("q_year_month_revenue", f"""
    SELECT year(d) AS "year", month(d) AS "month", count(*) AS "count", round(sum(CAST(cents AS DOUBLE)), 2) AS revenue
    FROM {ORDERS_DATED} o GROUP BY 1, 2
""")
def year_month_revenue(t: Tables) -> DataFrame:
    rows = cards.monthly_amounts(orders_dated(t), F.year("d"), F.month("d"), F.col("cents"))
    return rows.withColumn("revenue", F.round("revenue", 2))


YEARS = range(1995, 2002)
PIVOT_CELLS = ", ".join(
    f"CAST(coalesce(sum(CASE WHEN year(d) = {y} THEN cents END), 0) AS BIGINT) AS \"{y}\"" for y in YEARS)


@query("q_revenue_pivot", f"""
    SELECT month(d) AS m, concat(month(d), '月') AS "month", {PIVOT_CELLS}
    FROM {ORDERS_DATED} o WHERE o_orderpriority <> '' GROUP BY 1, 2
""")
def revenue_pivot(t: Tables) -> DataFrame:
    return cards.revenue_by_year(orders_dated(t), COLUMNS)[0]


@query("q_revenue_pivot_totals", f"SELECT {PIVOT_CELLS} FROM {ORDERS_DATED} o")
def revenue_pivot_totals(t: Tables) -> DataFrame:
    return cards.year_totals(*cards.revenue_by_year(orders_dated(t), COLUMNS, years=list(YEARS)))


def _profile_sql(columns: list[str], table: str, key: str) -> str:
    one = """SELECT '{c}' AS name, count(*) AS total_rows, count(*) FILTER ({c} IS NULL) AS null_count,
        count(DISTINCT {c}) AS distinct_count,
        (SELECT string_agg(CAST({c} AS VARCHAR), '|' ORDER BY {k}) FROM (SELECT * FROM {t} ORDER BY {k} LIMIT 3)) AS samples
        FROM {t}"""
    return " UNION ALL ".join(one.format(c=c, t=table, k=key) for c in columns)


CUSTOMER_VIEW = "(SELECT *, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer)"


@query("q_profile", _profile_sql(
    ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "segment"], CUSTOMER_VIEW, "c_custkey"))
def profile(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    stats = column_profile(rows, order=[F.asc("c_custkey")])
    return stats.drop("type").withColumn("samples", F.nullif(F.array_join("samples", "|"), F.lit("")))


@query("q_profile_sketches", " UNION ALL ".join(f"""
    SELECT '{c}' AS name, count(*) AS total_rows, count(*) FILTER ({c} IS NULL) AS null_count, 1 AS close FROM orders"""
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")))
def profile_sketches(t: Tables) -> DataFrame:
    """Sketches of each order status, merged: within 4 % of the exact distinct values."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    parts = [column_sketches(rows.filter(F.col("o_orderstatus") == s)) for s in ("F", "O", "P")]
    whole = merged_sketches(functools.reduce(DataFrame.unionByName, parts))
    exact = column_profile(rows, samples=0).select("name", "distinct_count")
    close = F.abs(F.col("approx_distinct") - F.col("distinct_count")) <= 0.04 * F.col("distinct_count")
    return whole.join(exact, "name").select(
        "name", "total_rows", "null_count", close.cast("int").alias("close"))


@query("q_filter_values", """
    WITH p AS (SELECT p_brand, p_type, p_name, CAST(p_partkey AS VARCHAR) AS p_partkey,
                      CASE WHEN p_size < 10 THEN '' WHEN p_size < 20 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS p_size FROM part),
    v AS (SELECT 'p_brand' AS "column", p_brand AS "value" FROM p UNION ALL SELECT 'p_type', p_type FROM p
          UNION ALL SELECT 'p_name', p_name FROM p UNION ALL SELECT 'p_size', p_size FROM p UNION ALL SELECT 'p_partkey', p_partkey FROM p)
    SELECT "column", "value", count(*) AS "count" FROM v WHERE "value" <> ''
        AND "column" IN (SELECT "column" FROM v GROUP BY 1 HAVING count(DISTINCT "value") <= 100)
    GROUP BY 1, 2
""")
def filter_value_counts(t: Tables) -> DataFrame:
    size = F.when(F.col("p_size") < 10, "").when(F.col("p_size") >= 20, F.col("p_size").cast("string"))
    rows = t.part.withColumn("p_size", size)
    return filter_values(rows, ["p_brand", "p_type", "p_name", "p_size", "p_partkey", "absent"], 100)


@query("q_explore", f"""
    SELECT o_orderkey, o_orderpriority, cents, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND contains(o_orderpriority, 'H')) AS total_rows
    FROM {ORDERS_DATED} o WHERE o_orderstatus = 'O' AND contains(o_orderpriority, 'H')
    ORDER BY o_orderkey LIMIT 50 OFFSET 50
""")
def explore(t: Tables) -> DataFrame:
    rows, total = cards.explore(
        orders_dated(t), [asc("o_orderkey")], number=2, size=50, category="O", text="H", cols=COLUMNS)
    return rows.select("o_orderkey", "o_orderpriority", "cents", total.scalar().alias("total_rows"))


@query("q_summary", f"""
    SELECT 'categories' AS section, CASE WHEN o_orderpriority = '5-LOW' THEN '予算' ELSE '課題リスト' END AS "key",
        count(*) AS "count" FROM orders GROUP BY 2
    UNION ALL SELECT 'statuses', o_orderstatus, count(*) FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'top_codes', CAST(o_custkey AS VARCHAR), count(*) FROM orders
        WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 10)
    UNION ALL SELECT 'monthly', concat(year(d), '-', coalesce(CAST(NULL AS VARCHAR), '')), count(*) FROM {ORDERS_DATED} o
        WHERE o_orderpriority <> '5-LOW' GROUP BY year(d)
    UNION ALL SELECT 'budget', o_orderstatus, count(*) FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 2
""")
def summary(t: Tables) -> DataFrame:
    low = F.col("o_orderpriority") == "5-LOW"
    report = orders_dated(t).select(
        F.when(low, cards.CATEGORY_BUDGET).otherwise(cards.CATEGORY_TASKS).alias("BLカテゴリ"),
        F.col("o_custkey").alias("ERAWANコード"), F.col("o_orderstatus").alias("ステータス名"),
        F.year("d").alias("請求年"), F.lit(None).cast("bigint").alias("請求月"),
        F.col("cents").alias("税抜費用（int）"), F.col("o_orderstatus").alias("カテゴリ"),
        F.col("cents").alias("売上予算額"), F.col("cents").alias("累計売上予算額"))
    parts = cards.summary(report)
    key = lambda c: F.col(c).cast("string").alias("key")
    section = lambda s: F.lit(s).alias("section")
    month = F.concat(F.col("year"), F.lit("-"), F.coalesce(F.col("month").cast("string"), F.lit("")))
    frames = [
        parts["categories"].select(section("categories"), key("BLカテゴリ"), "count"),
        parts["statuses"].select(section("statuses"), key("ステータス名"), "count"),
        parts["top_codes"].select(section("top_codes"), key("ERAWANコード"), "count"),
        parts["monthly"].select(section("monthly"), month.alias("key"), "count"),
        parts["budget"].groupBy("カテゴリ").agg(F.count(F.lit(1)).alias("count"))
        .select(section("budget"), key("カテゴリ"), "count"),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("q_generic_card", """
    SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS "F",
        round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS "O",
        round(avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS "P"
    FROM orders GROUP BY 1
""")
def generic_card(t: Tables) -> DataFrame:
    spec = cards.CardSpec("o_orderpriority", "o_totalprice", "AVG", pivot="o_orderstatus")
    wide = cards.build_card(t.orders, spec, ["F", "O", "P"])
    return wide.select("o_orderpriority", *[F.round(c, 2).alias(c) for c in "FOP"])


# A header without a value and one that is the text null, and more headers than a plan holds.
CARD_ROWS = """(SELECT o_orderpriority AS r, o_totalprice, o_orderkey % 1500 AS many,
    CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'P' THEN 'null' ELSE o_orderstatus END AS h FROM orders)"""


def _card_rows(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    header = F.when(status == "P", "null").when(status != "F", status)
    return t.orders.select(F.col("o_orderpriority").alias("r"), "o_totalprice",
                           (F.col("o_orderkey") % 1500).alias("many"), header.alias("h"))


@query("q_generic_card_nulls", f"""
    SELECT r, count(*) FILTER (h = 'O') AS "O", nullif(count(*) FILTER (h = 'null'), 0) AS "null",
        count(*) FILTER (h IS NULL) AS "(null)" FROM {CARD_ROWS} c WHERE o_totalprice >= 1000 GROUP BY r
    ORDER BY count(*) DESC, r LIMIT 3
""")
def generic_card_nulls(t: Tables) -> DataFrame:
    """The three largest rows of a pivot, with a NULL header beside the text null."""
    spec = cards.CardSpec("r", "*", "COUNT", pivot="h", filters={"o_totalprice": (">=", 1000)}, limit=3)
    return cards.build_card(_card_rows(t), spec)


@query("q_generic_card_cells", f"""
    SELECT CASE grouping(r, many) WHEN 0 THEN 'cell' WHEN 1 THEN 'row' WHEN 2 THEN 'header' ELSE 'all' END AS kind,
        r AS "row", many AS header, count(*) AS "value" FROM {CARD_ROWS} c WHERE h IS NULL
    GROUP BY GROUPING SETS ((r, many), (r), (many), ())
""")
def generic_card_cells(t: Tables) -> DataFrame:
    """A pivot of more headers than columns can hold, in long form with its totals."""
    spec = cards.CardSpec("r", "*", "COUNT", pivot="many", filters={"h": None})
    return cards.card_cells(_card_rows(t), spec)


@query("q_generic_card_top", """
    SELECT c_nationkey, count(*) AS "value" FROM customer WHERE c_mktsegment = 'BUILDING'
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5
""")
def generic_card_top(t: Tables) -> DataFrame:
    spec = cards.CardSpec("c_nationkey", "*", "COUNT", filters={"c_mktsegment": "BUILDING"}, limit=5)
    return cards.build_card(t.customer, spec)
