"""Filters, casts and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import casts, periods, predicates
from ledgerlens.functions.formulas import json_list
from ledgerlens.plans.monitor import duration_seconds, provider_choice, schedule_word
from ledgerlens.plans.revenue import calendar_months, issue_link, post_process, route_cost
from ledgerlens.queries.registry import (
    ORDERS_DATED, REF_DATE, Tables, orders_dated, period_sql, query,
)


@query("q_regex_prefix_filter", """
    SELECT o_orderkey, o_orderpriority FROM orders WHERE regexp_matches(o_orderpriority, '^[1-2]-')
""")
def regex_prefix_filter(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderpriority").rlike("^[1-2]-")).select(
        "o_orderkey", "o_orderpriority")


@query("q_date_split", f"""
    SELECT o_orderkey, CAST(b AS VARCHAR) AS billing,
           CASE WHEN b IS NULL THEN 'undated' ELSE 'dated' END AS branch
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS b
          FROM orders)
    WHERE b >= DATE '{REF_DATE}' OR b IS NULL
""")
def date_split(t: Tables) -> DataFrame:
    billing = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    rows = t.orders.select("o_orderkey", billing.alias("billing"))
    kept = rows.filter(predicates.on_or_after_or_undated(F.col("billing"), REF_DATE))
    return kept.withColumn("branch", F.when(F.col("billing").isNull(), "undated").otherwise("dated"))


LINK_BASE = "https://tracker.example/view/"


@query("q_project_subset_rename", f"""
    SELECT c_custkey AS "課題ID", c_mktsegment AS "ERAWANコード",
        '<a href="{LINK_BASE}' || c_name || '" target="_blank">' || c_name || '</a>' AS "課題URL"
    FROM customer
""")
def project_subset_rename(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("課題ID"), F.col("c_mktsegment").alias("ERAWANコード"),
        issue_link(F.col("c_name"), LINK_BASE).alias("課題URL"),
    )


@query("q_null_keeping_exclude", """
    SELECT p_partkey, n AS name FROM (SELECT p_partkey, nullif(p_name, 'hot ring') AS n FROM part)
    WHERE (n NOT LIKE '%plate%' OR n IS NULL) AND (n NOT LIKE 'small%' OR n IS NULL)
""")
def null_keeping_exclude(t: Tables) -> DataFrame:
    named = t.part.select("p_partkey", F.nullif("p_name", F.lit("hot ring")).alias("name"))
    return named.filter(predicates.keep_unless_like(F.col("name"), "%plate%", "small%"))


@query("q_in_list_filter", """
    SELECT o_orderkey, o_orderstatus FROM orders
    WHERE o_orderstatus IN ('F', 'P') AND o_orderdate IS NOT NULL AND o_orderpriority = '3-MEDIUM'
""")
def in_list_filter(t: Tables) -> DataFrame:
    wanted = predicates.one_of(F.col("o_orderstatus"), ("F", "P"), F.col("o_orderdate"))
    return t.orders.filter(wanted & (F.col("o_orderpriority") == "3-MEDIUM")).select(
        "o_orderkey", "o_orderstatus")


# A cost text of every kind, from the order's amount; the same expression in both engines.
COST_TEXT = """CASE o_orderpriority
    WHEN '1-URGENT' THEN left(cents_text, length(cents_text) - 3) || ',' || right(cents_text, 3)
    WHEN '2-HIGH' THEN cents_text
    WHEN '3-MEDIUM' THEN left(cents_text, length(cents_text) - 2) || '.' || right(cents_text, 2)
    WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderstatus = 'F' THEN '未定' ELSE '' END END"""


def costed(t: Tables) -> DataFrame:
    texts = orders_dated(t).withColumn("cents_text", F.col("cents").cast("string"))
    return texts.withColumn("cost", F.expr(COST_TEXT))


COSTED = f"""(SELECT *, {COST_TEXT} AS cost
    FROM (SELECT *, CAST(cents AS VARCHAR) AS cents_text FROM {ORDERS_DATED} o) o)"""


@query("q_cost_routing", f"""
    WITH c AS (SELECT o_orderkey, cost, replace(coalesce(cost, ''), ',', '') AS clean FROM {COSTED} x)
    SELECT o_orderkey, cost, CAST(clean AS BIGINT) AS cost_int, 'number' AS route FROM c
    WHERE clean <> '' AND NOT regexp_matches(clean, '[^0-9]')
    UNION ALL
    SELECT o_orderkey, cost, NULL, 'text' FROM c WHERE clean <> '' AND regexp_matches(clean, '[^0-9]')
    UNION ALL
    SELECT o_orderkey, cost, NULL, 'none' FROM c WHERE clean = ''
""")
def cost_routing(t: Tables) -> DataFrame:
    number = route_cost(F.col("cost"))
    empty = F.replace(F.coalesce("cost", F.lit("")), F.lit(","), F.lit("")) == ""
    route = F.when(number.isNotNull(), "number").when(empty, "none").otherwise("text")
    return costed(t).select("o_orderkey", "cost", number.alias("cost_int"), route.alias("route"))


DATE_TEXT = """CASE o_orderpriority
    WHEN '1-URGENT' THEN CAST(d AS STRING)
    WHEN '2-HIGH' THEN replace(CAST(d AS STRING), '-', '/')
    WHEN '3-MEDIUM' THEN left(CAST(d AS STRING), 7)
    WHEN '4-NOT SPECIFIED' THEN CAST(year(d) AS STRING) || '-' || CAST(month(d) AS STRING) || '-' || CAST(day(d) AS STRING)
    ELSE CASE o_orderstatus WHEN 'F' THEN CAST(d AS STRING) || ' 10:20:30'
        WHEN 'O' THEN CAST(year(d) AS STRING) || '-13-01' ELSE CAST(d AS STRING) || ' abc' END END"""
NUMBER_TEXT = """CASE o_orderstatus
    WHEN 'F' THEN CAST(cents AS STRING)
    WHEN 'O' THEN left(CAST(cents AS STRING), length(CAST(cents AS STRING)) - 1) || '.' || right(CAST(cents AS STRING), 1)
    ELSE CASE o_orderpriority WHEN '1-URGENT' THEN '-' || left(CAST(cents AS STRING), 2) || '.5'
        WHEN '2-HIGH' THEN right(CAST(cents AS STRING), 1) || 'e3' WHEN '3-MEDIUM' THEN ' ' || CAST(cents AS STRING) || ' '
        WHEN '4-NOT SPECIFIED' THEN '' ELSE CASE o_orderkey % 5 WHEN 0 THEN '１２' WHEN 1 THEN '1_000'
        WHEN 2 THEN '0x1F' WHEN 3 THEN '0b11' ELSE CAST(cents AS STRING) || '円' END END END"""


@query("q_try_casts", f"""
    SELECT o_orderkey, date_text, number_text, CAST(TRY_CAST(date_text AS DATE) AS VARCHAR) AS as_date,
        TRY_CAST(number_text AS BIGINT) AS as_bigint
    FROM (SELECT o_orderkey, {DATE_TEXT} AS date_text, {NUMBER_TEXT} AS number_text FROM {ORDERS_DATED} o) o
""")
def try_casts(t: Tables) -> DataFrame:
    texts = orders_dated(t).selectExpr(
        "o_orderkey", f"{DATE_TEXT} AS date_text", f"{NUMBER_TEXT} AS number_text")
    return texts.select(
        "*", casts.try_date(F.col("date_text")).alias("as_date"),
        casts.try_bigint(F.col("number_text")).alias("as_bigint"))


MONTH_TEXT = """CASE o_orderstatus
    WHEN 'F' THEN CAST(year(d) AS STRING) || '年' || lpad(CAST(month(d) AS STRING), 2, '0') || '月'
    WHEN 'O' THEN CAST(year(d) AS STRING) || lpad(CAST(month(d) AS STRING), 2, '0')
    ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN '未定' ELSE CAST(year(d) AS STRING) || '年13月' END END"""


@query("q_parse_year_month", f"""
    SELECT o_orderkey, txt, CASE WHEN mo BETWEEN 1 AND 12 THEN CAST(make_date(yr, mo, 1) AS VARCHAR) END AS month_first
    FROM (SELECT *, regexp_replace(txt, '[^0-9]', '', 'g') AS dg
              , TRY_CAST(substr(regexp_replace(txt, '[^0-9]', '', 'g'), 1, 4) AS BIGINT) AS yr,
              TRY_CAST(regexp_replace(txt, '[^0-9]', '', 'g') AS BIGINT) % 100 AS mo
          FROM (SELECT o_orderkey, {MONTH_TEXT} AS txt FROM {ORDERS_DATED} o))
    WHERE length(dg) > 0
""")
def parse_year_month(t: Tables) -> DataFrame:
    texts = orders_dated(t).selectExpr("o_orderkey", f"{MONTH_TEXT} AS txt")
    return texts.filter(casts.has_digits(F.col("txt"))).withColumn(
        "month_first", casts.parse_year_month(F.col("txt")))


@query("q_month_end", f"""
    SELECT o_orderkey, CAST(CAST(date_trunc('month', d) AS DATE) AS VARCHAR) AS month_first,
        CAST(CAST(date_trunc('month', d) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS month_last
    FROM {ORDERS_DATED} o
""")
def month_end(t: Tables) -> DataFrame:
    first = periods.month_start(F.col("d"))
    return orders_dated(t).select(
        "o_orderkey", first.alias("month_first"), periods.month_end(first).alias("month_last"))


@query("q_period_bucket", f"""
    SELECT o_orderkey, {period_sql('d')} AS period
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN d END AS d FROM {ORDERS_DATED} o)
""")
def period_bucket(t: Tables) -> DataFrame:
    date = F.when(F.col("o_orderstatus") != "P", F.col("d"))
    return orders_dated(t).select("o_orderkey", periods.period_label(date, REF_DATE).alias("period"))


@query("q_calendar_filter", f"""
    WITH days AS (SELECT DISTINCT year(d) AS y, lpad(CAST(month(d) AS VARCHAR), 2, '0') AS m,
                         lpad(CAST(day(d) AS VARCHAR), 2, '0') AS dd FROM {ORDERS_DATED} o)
    SELECT y AS calendar_year, m AS calendar_month, concat(y, '-', m, '-01') AS calendar_date,
        CAST(m AS INTEGER) AS calendar_month_int, concat(y, '-', m) AS year_month
    FROM days WHERE y >= 1997 AND dd = '01' AND CAST(concat(y, '-', m, '-', dd) AS DATE) <= DATE '2000-12-31'
""")
def calendar_filter(t: Tables) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    days = orders_dated(t).select(
        F.year("d").alias("calendar_year"), two(F.month("d")).alias("calendar_month"),
        two(F.day("d")).alias("calendar_date")).distinct()
    months = calendar_months(days, 1997).filter(F.col("calendar_date") <= "2000-12-31")
    return months.withColumn("calendar_year", F.col("calendar_year").cast("bigint"))


@query("q_post_process", f"""
    SELECT o_orderkey, CASE WHEN parent IS NOT NULL THEN '子課題' ELSE '親課題' END AS kind,
        {period_sql('d')} AS period, year(d) AS bill_year,
        CASE WHEN regexp_matches(replace(coalesce(cost, ''), ',', ''), '^[0-9]+$')
             THEN CAST(replace(cost, ',', '') AS BIGINT) END AS cost_int,
        concat(month(d), '月') AS month_label
    FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS parent FROM {COSTED} x)
""")
def post_processed(t: Tables) -> DataFrame:
    tasks = costed(t).select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("親課題ID"),
        F.col("d").alias("請求日"), F.col("cost").alias("税抜費用"))
    return post_process(tasks, REF_DATE).select(
        "o_orderkey", F.col("親/子課題").alias("kind"), F.col("請求日（期）").alias("period"),
        F.col("請求年").alias("bill_year"), F.col("税抜費用（int）").alias("cost_int"),
        periods.month_label(F.col("請求日")).alias("month_label"))


@query("q_optional_filters", """
    SELECT p_partkey, p_type, p_size FROM part
    WHERE lower(p_type) = 'promo' AND p_size >= 10 AND p_size < 30 AND contains(p_name, 'ring')
""")
def optional_filters(t: Tables) -> DataFrame:
    wanted = [
        *predicates.search({"p_name": "RING", "p_brand": " "}, {"p_type": " Promo ", "p_name": ""}),
        *predicates.at_least(F.col("p_size"), 10, null_is_zero=False),
        *predicates.at_least(F.col("p_retailprice"), 0, null_is_zero=True),
        *predicates.card_count_direction(F.col("p_size"), "lt", 30),
        *predicates.card_count_direction(F.col("p_size"), None, 5),
    ]
    return predicates.where_all(t.part, wanted).select("p_partkey", "p_type", "p_size")


@query("q_json_parse", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
        CASE WHEN event_type = 'error' THEN '' ELSE array_to_string(CAST(json_extract_string(lst, '$[*]') AS VARCHAR[]), ',') END AS items
    FROM (SELECT *, '["' || event_type || '", "' || user_id || '"]' AS lst FROM events)
""")
def json_parse(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "not a list").otherwise(
        F.concat(F.lit('["'), "event_type", F.lit('", "'), F.col("user_id").cast("string"), F.lit('"]')))
    return t.events.select(
        "event_id", F.from_json("props", "k BIGINT")["k"].alias("k"),
        F.array_join(json_list(text), ",").alias("items"))


@query("q_epoch_autodetect", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
        ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS at
    FROM events
""")
def epoch_autodetect(t: Tables) -> DataFrame:
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    epoch = (F.when(F.col("event_type") == "error", 0)
             .when(F.col("event_type") == "view", seconds).otherwise(millis))
    at = F.date_trunc("second", casts.epoch_timestamp(epoch))
    return t.events.select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("q_duration", """
    SELECT event_id, CASE WHEN b <> 0 AND e <> 0 THEN (e - b) / 1000.0 END AS duration_seconds
    FROM (SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 0 ELSE (epoch_us(ts) // 1000) END AS b,
                 CASE WHEN event_type <> 'signup' THEN (epoch_us(ts) // 1000) + CAST(round(value * 1000) AS BIGINT) END AS e
          FROM events)
""")
def duration(t: Tables) -> DataFrame:
    ms, kind = F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_type")
    begin = F.when(kind == "view", 0).when(kind != "error", ms)
    end = F.when(kind != "signup", ms + F.round(F.col("value") * 1000).cast("bigint"))
    return t.events.select(
        "event_id", duration_seconds(begin, end).cast("double").alias("duration_seconds"))


@query("q_provider_choice", """
    SELECT p_partkey,
        CASE WHEN p_type <> 'STANDARD' THEN p_type
             WHEN brand <> '' THEN brand ELSE p_type END AS provider,
        CASE WHEN p_size > 40 THEN '' WHEN p_size % 2 = 0 THEN 'ACTIVE' ELSE 'INACTIVE' END AS schedule_state
    FROM (SELECT *, CASE WHEN p_size < 25 THEN p_brand ELSE '' END AS brand FROM part)
""")
def provider(t: Tables) -> DataFrame:
    kind, brand = F.col("p_type"), F.when(F.col("p_size") < 25, F.col("p_brand")).otherwise("")
    none = F.lit(None).cast("string")
    active = F.when(F.col("p_size") <= 40, F.col("p_size") % 2 == 0)
    return t.part.select(
        "p_partkey", provider_choice([kind, none, brand], [kind, brand]).alias("provider"),
        schedule_word(active).alias("schedule_state"))
