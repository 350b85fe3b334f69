"""Joins, merges, windows, paging, reshaping, sources and sinks."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.formulas import referenced_ids
from ledgerlens.functions.periods import half_year_index, month_start, period_label
from ledgerlens.functions.predicates import severity
from ledgerlens.operators import merging, ordering, reshape
from ledgerlens.operators.aggregates import child_counts, count_by, distinct_values
from ledgerlens.operators.merging import ARRIVAL
from ledgerlens.operators.ordering import asc
from ledgerlens.queries.registry import (
    ORDERS_DATED, REF_DATE, Tables, orders_dated, period_sql, query,
)
from ledgerlens.session import broadcast_if_small, scratch_path
from ledgerlens.sources.files import (
    input_files, load_inputs, read_config, read_csv, read_csv_named, read_json_lines, text_schema,
)
from ledgerlens.sources.sinks import (
    StepCounts, input_sizes, read_snapshot, replace_table, write_csv, write_snapshot,
)
from ledgerlens.sources.store import Store


# ---- joins ----

@query("q_left_join_dim", """
    SELECT c_custkey, c_name, n_name FROM customer
    LEFT JOIN nation n ON c_nationkey + 10 = n_nationkey
""")
def left_join_dim(t: Tables) -> DataFrame:
    # Shifted keys, so that some customers have no nation.
    joined = t.customer.join(t.nation, F.col("c_nationkey") + 10 == F.col("n_nationkey"), "left")
    return joined.select("c_custkey", "c_name", "n_name")


EXPAND_SQL = f"""
    WITH months AS (SELECT DISTINCT CAST(date_trunc('month', d) AS DATE) AS m FROM {ORDERS_DATED} o),
    subs AS (SELECT o_orderkey, CAST(date_trunc('month', d) AS DATE) AS s,
        CASE o_orderstatus WHEN 'F' THEN CAST(d + INTERVAL 5 MONTH AS DATE)
             WHEN 'P' THEN CAST(d - INTERVAL 2 MONTH AS DATE) END AS e FROM {ORDERS_DATED} o)
    SELECT o_orderkey, CAST(m AS VARCHAR) AS month_first FROM subs
    JOIN months ON m >= s AND m <= coalesce(e, CAST(date_trunc('month', DATE '{REF_DATE}') AS DATE))
"""


def _subscriptions(t: Tables) -> tuple[DataFrame, DataFrame]:
    o, status = orders_dated(t), F.col("o_orderstatus")
    end = F.when(status == "F", F.add_months("d", 5)).when(status == "P", F.add_months("d", -2))
    open_end = month_start(F.lit(REF_DATE).cast("date"))
    subs = o.select("o_orderkey", month_start(F.col("d")).alias("s"),
                    F.coalesce(end, open_end).alias("e"))
    return subs, o.select(month_start(F.col("d")).alias("month_first")).distinct()


@query("q_expand_months", EXPAND_SQL)
def expand_months(t: Tables) -> DataFrame:
    subs, months = _subscriptions(t)
    rows = reshape.expand_months(subs.select("e", "s", "o_orderkey"), F.col("s"), F.col("e"), months, "month_first")
    return rows.select("o_orderkey", "month_first")


@query("q_expand_months_seq", EXPAND_SQL)
def expand_months_seq(t: Tables) -> DataFrame:
    subs, months = _subscriptions(t)
    rows = reshape.expand_months(subs, F.col("s"), F.col("e"), months, "month_first")
    return rows.select("o_orderkey", "month_first")


@query("q_nullsafe_join", f"""
    WITH k AS (SELECT *, CASE WHEN o_orderpriority <> '5-LOW' THEN date_trunc('month', d) END AS m FROM {ORDERS_DATED} o)
    SELECT f.o_orderkey AS forecast_key, a.o_orderkey AS actual_key FROM k f
    LEFT JOIN (SELECT * FROM k WHERE o_orderstatus = 'F') a ON f.m IS NOT DISTINCT FROM a.m
        AND f.o_custkey IS NOT DISTINCT FROM a.o_custkey
        AND f.o_orderpriority IS NOT DISTINCT FROM a.o_orderpriority
""")
def nullsafe_join(t: Tables) -> DataFrame:
    month = F.when(F.col("o_orderpriority") != "5-LOW", month_start(F.col("d")))
    k = orders_dated(t).select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus",
                               month.alias("m"))
    f, a = k.alias("f"), k.filter("o_orderstatus = 'F'").alias("a")
    same = (F.col("f.m").eqNullSafe(F.col("a.m"))
            & F.col("f.o_custkey").eqNullSafe(F.col("a.o_custkey"))
            & F.col("f.o_orderpriority").eqNullSafe(F.col("a.o_orderpriority")))
    return f.join(a, same, "left").select(
        F.col("f.o_orderkey").alias("forecast_key"), F.col("a.o_orderkey").alias("actual_key"))


@query("q_child_count", """
    SELECT o_orderkey, n AS children FROM orders
    LEFT JOIN (SELECT l_orderkey, count(l_linenumber) AS n FROM lineitem
               WHERE l_returnflag <> 'R' GROUP BY l_orderkey) c ON o_orderkey = l_orderkey
""")
def child_count(t: Tables) -> DataFrame:
    parent = F.when(F.col("l_returnflag") != "R", F.col("l_orderkey")).alias("parent")
    counts = child_counts(t.lineitem.select(parent, "l_linenumber"), "parent", "l_linenumber", "children")
    return merging.lookup(t.orders.select("o_orderkey"), counts, "o_orderkey", "parent")


@query("q_lookup_hot_keys", """
    SELECT event_id, c_name FROM events
    LEFT JOIN customer ON CASE event_type WHEN 'click' THEN 7 WHEN 'view' THEN NULL ELSE user_id END = c_custkey
""")
def lookup_hot_keys(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    key = F.when(kind == "click", 7).when(kind != "view", F.col("user_id"))
    rows = t.events.select("event_id", key.alias("key"))
    names = t.customer.select("c_custkey", "c_name")
    return merging.lookup(rows, names, "key", "c_custkey", hot_rows=2).select("event_id", "c_name")


@query("q_conform_filter", """
    SELECT k AS id, name, n_name AS nation, source, status FROM (
        SELECT c_custkey AS k, c_name AS name, c_nationkey AS nk, 'customer' AS source, '完了' AS status FROM customer
        UNION ALL SELECT s_suppkey, s_name, s_nationkey, 'supplier', '完了' FROM supplier)
    LEFT JOIN nation ON nk = n_nationkey WHERE nk = 7
""")
def conform_filter(t: Tables) -> DataFrame:
    customers = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nk"), F.lit("customer").alias("source"))
    suppliers = t.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nk"), F.lit("supplier").alias("source"))
    union = customers.unionByName(suppliers).withColumn("status", F.lit("完了"))
    named = union.join(broadcast_if_small(t.nation), F.col("nk") == F.col("n_nationkey"), "left")
    return named.filter("nk = 7").select("id", "name", F.col("n_name").alias("nation"), "source", "status")


# ---- merges ----

@query("q_overlay_detail", """
    SELECT c_custkey AS id, coalesce(nullif(dname, ''), c_name) AS name,
        coalesce(dbal, c_acctbal) AS balance, c_mktsegment AS segment
    FROM customer LEFT JOIN (SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN '' ELSE s_name END AS dname,
        CASE WHEN s_nationkey < 18 THEN s_acctbal END AS dbal FROM supplier) d ON c_custkey = s_suppkey
""")
def overlay_detail(t: Tables) -> DataFrame:
    base = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    detail = t.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.when(F.col("s_nationkey") < 10, "").otherwise(F.col("s_name")).alias("name"),
        F.when(F.col("s_nationkey") < 18, F.col("s_acctbal")).alias("balance"))
    # An earlier row of every key, greater in all columns, must not count nor double the base row.
    earlier = detail.withColumns({"name": F.lit("zzz"), "balance": F.lit(1e12), ARRIVAL: F.lit(1)})
    return merging.overlay(base, earlier.unionByName(detail.withColumn(ARRIVAL, F.lit(2))), ["id"])


@query("q_first_wins_merge", """
    SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'type' ELSE 'cards' END AS found_by
    FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 5000
""")
def first_wins_merge(t: Tables) -> DataFrame:
    tag = lambda cond, word: t.customer.filter(cond).select(
        F.col("c_custkey").alias("id"), F.lit(word).alias("found_by"))
    lists = [tag("c_mktsegment = 'BUILDING'", "type"), tag("c_acctbal > 5000", "cards")]
    return merging.first_wins(lists, ["id"])


@query("q_last_wins_propagate", """
    WITH hits AS (SELECT unnest([user_id, user_id + 1]) AS id, event_type, ts, event_id FROM events
                  WHERE event_type <> 'view'),
    last AS (SELECT id, arg_max(event_type, (ts, event_id)) AS state FROM hits GROUP BY id)
    SELECT c_custkey, coalesce(state, 'NEW') AS state FROM customer LEFT JOIN last ON c_custkey = id
""")
def last_wins_propagate(t: Tables) -> DataFrame:
    customers = t.customer.select("c_custkey", F.lit("NEW").alias("state"))
    value = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    ids = F.array("user_id", F.col("user_id") + 1)
    return merging.propagate_last(
        customers, "c_custkey", "state", t.events, ids, value, [F.col("ts"), F.col("event_id")])


@query("q_latest_per_key", """
    SELECT user_id, event_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_per_key(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "event_type", "ts")
    return merging.best_per_key(rows, ["user_id"], [F.col("ts"), F.col("event_id")]).drop("ts")


UPSERT_SQL = """
    SELECT coalesce(c_custkey, id) AS c_custkey, CASE WHEN id IS NOT NULL THEN nm ELSE c_name END AS c_name,
        CASE WHEN id IS NOT NULL THEN bal ELSE c_acctbal END AS c_acctbal, c_mktsegment
    FROM customer FULL JOIN (SELECT s_suppkey * 20 AS id, s_name AS nm, nullif(s_acctbal, 0) AS bal FROM supplier) u
    ON c_custkey = id
"""


def _upserted(t: Tables) -> tuple[DataFrame, DataFrame]:
    target = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    latest = t.supplier.select(
        (F.col("s_suppkey") * 20).alias("c_custkey"), F.col("s_name").alias("c_name"),
        F.nullif("s_acctbal", F.lit(0)).alias("c_acctbal"), F.lit(2).alias("seq"))
    older = latest.withColumns({"c_name": F.lit("old"), "seq": F.lit(1)})
    return target, latest.unionByName(older)


@query("q_upsert", UPSERT_SQL)
def upsert(t: Tables) -> DataFrame:
    target, updates = _upserted(t)
    return merging.upsert(target, updates, ["c_custkey"], sequence="seq")


# ---- windows, order, paging ----

RUNNING_SQL = f"""
    SELECT o_orderkey, period,
        CAST(sum(cents) OVER w AS BIGINT) AS forecast,
        CAST(sum(CASE WHEN o_orderstatus = 'F' THEN cents END) OVER w AS BIGINT) AS actual
    FROM (SELECT *, {period_sql('d')} AS period FROM {ORDERS_DATED} o)
    WINDOW w AS (PARTITION BY period ORDER BY d, o_orderkey ROWS UNBOUNDED PRECEDING)
"""


def _running(t: Tables) -> tuple:
    o = orders_dated(t).withColumn("period", period_label(F.col("d"), REF_DATE))
    sums = {"forecast": F.col("cents"),
            "actual": F.when(F.col("o_orderstatus") == "F", F.col("cents"))}
    return o, sums, ["period"], [asc("d"), asc("o_orderkey")]


RUNNING_COLUMNS = ["o_orderkey", "period", "forecast", "actual"]


@query("q_running_sum", RUNNING_SQL)
def running_sum(t: Tables) -> DataFrame:
    return ordering.running_sums(*_running(t)).select(*RUNNING_COLUMNS)


@query("q_running_sum_ranged", RUNNING_SQL)
def running_sum_ranged(t: Tables) -> DataFrame:
    return ordering.running_sums(*_running(t), range_rows=5_000).select(*RUNNING_COLUMNS)


@query("q_running_sum_2key", """
    SELECT l_orderkey, l_linenumber, half, l_returnflag,
        CAST(sum(qty) OVER (PARTITION BY half, l_returnflag ORDER BY d, l_orderkey, l_linenumber, l_partkey, l_suppkey, qty
            ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_qty
    FROM (SELECT *, CAST(l_shipdate AS DATE) AS d, CAST(l_quantity AS BIGINT) AS qty,
        CAST(floor((year(l_shipdate) - 2024) * 2 + ((month(l_shipdate) - 1) / 6.0)) AS BIGINT) AS half FROM lineitem)
""")
def running_sum_2key(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey",
        F.to_date("l_shipdate").alias("d"), F.col("l_quantity").cast("bigint").alias("qty"))
    rows = rows.withColumn("half", half_year_index(F.col("d")).cast("bigint"))
    order = [asc(c) for c in ("d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty")]
    summed = ordering.running_sums(
        rows, {"running_qty": F.col("qty")}, ["half", "l_returnflag"], order)
    return summed.select("l_orderkey", "l_linenumber", "half", "l_returnflag", "running_qty")


@query("q_global_row_number", f"""
    SELECT o_orderkey, row_number() OVER (ORDER BY d, o_orderkey) AS id FROM {ORDERS_DATED} o
""")
def global_row_number(t: Tables) -> DataFrame:
    o = orders_dated(t).select("o_orderkey", "d")
    order = [asc("d"), asc("o_orderkey")]
    return ordering.global_row_number(o, order, "id", range_rows=5_000).select("o_orderkey", "id")


def _paged(t: Tables, top_rows: int) -> DataFrame:
    order = ordering.sort_columns("cents", "DESC", ["cents", "d"], "d", ["o_orderkey"])
    hits = orders_dated(t).filter(F.col("o_orderpriority").contains("E"))
    return ordering.page(hits, order, 3, 100, top_rows).select("o_orderkey", "cents")


PAGE_SQL = f"""
    SELECT o_orderkey, cents FROM {ORDERS_DATED} o WHERE contains(o_orderpriority, 'E')
    ORDER BY cents DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 200
"""


@query("q_page", PAGE_SQL)
def page(t: Tables) -> DataFrame:
    return _paged(t, ordering.TOP_ROWS)


@query("q_page_deep", PAGE_SQL)
def page_deep(t: Tables) -> DataFrame:
    return _paged(t, 1_000)


@query("q_severity_sort_top", """
    SELECT event_id, state, CASE WHEN state = 'FAILED' THEN 0 WHEN state = 'stale' THEN 1 ELSE 2 END AS sev FROM (
        SELECT *, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'stale' ELSE event_type END AS state FROM events)
    ORDER BY sev, ts DESC NULLS LAST, event_id LIMIT 50
""")
def severity_sort_top(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind == "error", "FAILED").when(kind == "view", "stale").otherwise(kind)
    rows = t.events.select("event_id", "ts", state.alias("state"))
    ranked = rows.withColumn("sev", severity(F.col("state")))
    order = [F.asc("sev"), F.desc_nulls_last("ts"), F.asc("event_id")]
    return ordering.top(ranked, 50, *order).drop("ts")


@query("q_head", """
    SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 3
""")
def head(t: Tables) -> DataFrame:
    return ordering.top(t.orders, 3, F.asc("o_orderkey")).select("o_orderkey", "o_orderstatus")


@query("q_count_by_category_top", """
    SELECT l_returnflag, l_linestatus, count(*) AS "count" FROM lineitem
    GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 4
""")
def count_by_category_top(t: Tables) -> DataFrame:
    return count_by(t.lineitem, "l_returnflag", "l_linestatus", k=4)


@query("q_distinct_values", """
    SELECT DISTINCT ty AS p_type FROM (SELECT CASE WHEN p_size < 5 THEN '' WHEN p_type = 'PROMO' THEN NULL ELSE p_type END AS ty FROM part)
    WHERE ty <> ''
""")
def distinct_list(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_size") < 5, "").when(F.col("p_type") != "PROMO", F.col("p_type"))
    return distinct_values(t.part.select(kind.alias("p_type")), "p_type")


# ---- reshaping ----

@query("q_union_by_name", """
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance, 'customer' AS kind FROM customer
    UNION ALL BY NAME SELECT 'supplier' AS kind, s_acctbal AS balance, s_suppkey AS id, s_name AS name FROM supplier
""")
def union_by_name(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                          F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("kind"))
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                          F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"))
    return c.unionByName(s, allowMissingColumns=True)


@query("q_unpivot_pairs", """
    WITH l AS (SELECT *, nullif(l_returnflag, 'A') AS flag, CAST(l_quantity AS BIGINT) AS qty,
        CASE WHEN l_quantity < 25 THEN CAST(l_partkey AS BIGINT) END AS part FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_suppkey, 'flag' AS slot, flag AS who, 'qty' AS weight_slot, qty AS weight FROM l
    UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, 'status', l_linestatus, 'part', part FROM l
""")
def unpivot_pairs(t: Tables) -> DataFrame:
    part = F.when(F.col("l_quantity") < 25, F.col("l_partkey"))
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.nullif("l_returnflag", F.lit("A")).alias("flag"),
        F.col("l_quantity").cast("bigint").alias("qty"), F.col("l_linestatus").alias("status"),
        part.alias("part"))
    pairs = [("flag", "qty"), ("status", "part")]
    return reshape.unpivot_pairs(rows, pairs, "slot", "who", "weight_slot", "weight")


@query("q_unpivot_months", f"""
    WITH y AS (SELECT DISTINCT year(d) AS y, o_orderpriority AS p FROM {ORDERS_DATED} o),
    s AS (SELECT year(d) AS y, month(d) AS m, o_orderpriority AS p, CAST(sum(cents) AS BIGINT) AS amount
          FROM {ORDERS_DATED} o WHERE o_orderstatus = 'F' GROUP BY 1, 2, 3)
    SELECT y.y AS "year", y.p AS priority, CAST(g.m AS INTEGER) AS "month", s.amount FROM y
    JOIN (SELECT unnest(range(1, 13)) AS m) g ON TRUE LEFT JOIN s ON s.y = y.y AND s.p = y.p AND s.m = g.m
""")
def unpivot_months(t: Tables) -> DataFrame:
    amount = F.when(F.col("o_orderstatus") == "F", F.col("cents"))
    flat = orders_dated(t).select(
        F.year("d").cast("bigint").alias("year"), F.col("o_orderpriority").alias("priority"),
        F.month("d").alias("m"), amount.alias("amount"))
    months = list(range(1, 13))
    wide = flat.groupBy("year", "priority").pivot("m", months).agg(F.sum("amount"))
    return reshape.unpivot_numbered(wide, [str(m) for m in months], "month", "amount")


@query("q_explode_links", """
    SELECT l_orderkey AS id, CAST(l_partkey AS VARCHAR) AS resource_id FROM lineitem
    WHERE l_linestatus = 'O' AND l_returnflag <> 'R'
""")
def explode_links(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_linestatus") == "O", "CARD").otherwise("DATA_SOURCE")
    link = F.struct(
        (F.col("l_returnflag") != "R").alias("active"),
        F.struct(kind.alias("type"), F.col("l_partkey").cast("string").alias("id")).alias("resource"))
    records = t.lineitem.select(F.col("l_orderkey").alias("id"), F.array(link).alias("links"))
    return reshape.exploded_links(records, ["id"], "links", "CARD")


@query("q_extract_refs", """
    SELECT DISTINCT bm_id, depends_on_bm_id FROM (
        SELECT l_orderkey AS bm_id, l_partkey AS depends_on_bm_id FROM lineitem
        UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem)
""")
def extract_refs(t: Tables) -> DataFrame:
    text = F.format_string(
        "CASE WHEN FORMULA_REF(%d) > 0 THEN FORMULA_REF(%d) ELSE formula_ref(1) + FORMULA_REF(x) END",
        "l_partkey", "l_suppkey")
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey")
    formulas = rows.select("l_orderkey", text.alias("expression"))
    return reshape.edges(
        formulas, "l_orderkey", referenced_ids(F.col("expression")), "bm_id", "depends_on_bm_id")


@query("q_upsert_repeated", UPSERT_SQL)
def upsert_repeated(t: Tables) -> DataFrame:
    """Repeated keys in landed files: the last to arrive counts, though the first are greater."""
    target, updates = _upserted(t)
    return merging.upsert(target, _landed(updates), ["c_custkey"])


def _landed(updates: DataFrame) -> DataFrame:
    """The updates written to two files as JSON lines, the older ones first, and read again."""
    folder = scratch_path(updates.sparkSession, "landed")
    name = F.when(F.col("seq") == 1, "zzz").otherwise(F.col("c_name"))
    for n, of in (("a", "seq = 1"), ("b", "seq = 2")):
        part = updates.filter(of).withColumn("c_name", name).drop("seq")
        part.write.json(f"{folder}/{n}")
        if n == "b":  # within a file, too, a later line wins
            twice = part.withColumn("c_name", F.lit("zz"))
            twice.unionByName(part).coalesce(1).write.json(f"{folder}/c")
    schema = updates.drop("seq").schema
    return read_json_lines(updates.sparkSession, [f"{folder}/{n}" for n in "abc"], schema, arrival=True)


@query("q_upsert_incremental", UPSERT_SQL)
def upsert_incremental(t: Tables) -> DataFrame:
    """Landed updates merged into a stored table, of which only the touched buckets are written."""
    target, updates = _upserted(t)
    store = Store(t.spark, scratch_path(t.spark, "store"))
    store.publish({"customer": target}, {"customer": ["c_custkey"]})
    landed = _landed(updates)
    half = F.col("c_custkey") % 40 == 0
    store.upsert("customer", landed.filter(half))
    store.upsert("customer", landed.filter(~half))
    return store.read("customer")


@query("q_refresh_tables", """
    SELECT 'nation' AS "table", n_nationkey AS id, n_name AS name FROM nation
    UNION ALL SELECT 'region', r_regionkey, r_name FROM region
""")
def refresh_tables(t: Tables) -> DataFrame:
    """Two tables refreshed together; a run that fails in between leaves the old pair."""
    store = Store(t.spark, scratch_path(t.spark, "store"))
    nation = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    region = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    store.publish({"nation": nation.limit(0), "region": region.limit(0)})
    store.publish({"nation": nation, "region": region})
    broken = region.withColumn("name", F.when(F.col("id") >= 0, F.raise_error(F.lit("broken on purpose"))))
    try:
        store.publish({"nation": nation.withColumn("name", F.lit("new")), "region": broken})
    except Exception as e:  # the job's own error
        if "broken on purpose" not in str(e):
            raise
    both = [store.read(n).select(F.lit(n).alias("table"), "id", "name") for n in ("nation", "region")]
    return both[0].unionByName(both[1])


# ---- sources and sinks ----

@query("q_named_inputs", """
    SELECT 'nations' AS input, n_nationkey || '' AS id, n_name AS name FROM nation
    UNION ALL SELECT 'regions', r_regionkey || '', r_name FROM region
""")
def named_inputs(t: Tables) -> DataFrame:
    """Inputs by their logical names, from the files that a configuration names."""
    folder = scratch_path(t.spark, "in")
    write_csv(t.nation, f"{folder}/nation.csv")
    write_csv(t.region, f"{folder}/region.csv")
    config = {"inputs": [{"name": "nations", "file": "nation.csv"}, {"name": "regions", "file": "region.csv"}]}
    t.spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.text(f"{folder}/config")
    files = input_files(read_config(t.spark, f"{folder}/config"))
    wanted = {"nations": ["n_nationkey", "n_name"], "regions": ["r_regionkey", "r_name"]}
    found = load_inputs(t.spark, folder, files, wanted)
    return functools.reduce(DataFrame.union, [
        found[n].select(F.lit(n).alias("input"), F.col(c[0]).alias("id"), F.col(c[1]).alias("name"))
        for n, c in wanted.items()])


@query("q_step_and_input_counts", """
    SELECT 'step' AS kind, 'all' AS name, count(*) AS "rows", NULL AS "columns" FROM orders
    UNION ALL SELECT 'step', 'finished', count(*) FILTER (o_orderstatus = 'F'), NULL FROM orders
    UNION ALL SELECT 'input', 'nation', (SELECT count(*) FROM nation), 3
    UNION ALL SELECT 'input', 'region', (SELECT count(*) FROM region), 2
""")
def step_and_input_counts(t: Tables) -> DataFrame:
    """Rows of each step, observed while it was written, and the sizes of inputs."""
    steps = StepCounts()
    finished = steps.watch("finished", steps.watch("all", t.orders).filter("o_orderstatus = 'F'"))
    finished.write.format("noop").mode("overwrite").save()
    counted = t.spark.createDataFrame(
        [("step", n, c, None) for n, c in steps.result().items()],
        "kind string, name string, rows long, columns int")
    sizes = input_sizes({"nation": t.nation.select("n_nationkey", "n_name", "n_regionkey"),
                         "region": t.region.select("r_regionkey", "r_name")})
    return counted.unionByName(sizes.select(
        F.lit("input").alias("kind"), F.col("table").alias("name"), "rows", "columns"))


@query("q_csv_malformed", """
    SELECT setting, selection, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders,
        (VALUES ('lines'), ('multi')) s(setting), (VALUES ('all'), ('one'), ('count')) c(selection)
    WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 GROUP BY setting, selection
""")
def csv_malformed(t: Tables) -> DataFrame:
    """Rows too short or too long are skipped, whatever the columns selected, with cells of one
    line and with cells of two, whose breaks are quoted."""
    out = []
    for setting, cell in (("lines", F.col("o_orderstatus")), ("multi", F.concat(
            F.lit('"'), "o_orderstatus", F.lit(' ""x""\n, y"')))):
        path = scratch_path(t.spark, f"orders_{setting}")
        _write_lines(t.orders, cell, path)
        df = read_csv(t.spark, path, text_schema(["o_orderkey", "o_orderstatus"]))
        if setting == "multi":
            df = df.filter(F.col("o_orderstatus").endswith(' "x"\n, y'))
        total = F.sum(F.col("o_orderkey").cast("bigint")).alias("total")
        whole = df.agg(F.count("o_orderstatus").alias("n"), total)
        one = df.select("o_orderkey").agg(F.count("o_orderkey").alias("n"), total)
        count = df.agg(F.count(F.lit(1)).alias("n")).withColumn("total", one.select("total").scalar())
        for selection, found in (("all", whole), ("one", one), ("count", count)):
            out.append(found.select(F.lit(setting).alias("setting"), F.lit(selection).alias("selection"), "n", "total"))
    return functools.reduce(DataFrame.union, out)


def _write_lines(orders: DataFrame, cell: Column, path: str) -> None:
    """Text files of a header and a line per order; every seventh is too short, every eleventh too long."""
    key = F.col("o_orderkey").cast("string")
    line = F.when(F.col("o_orderkey") % 7 == 0, key).when(
        F.col("o_orderkey") % 11 == 0, F.concat(key, F.lit(",F,more"))).otherwise(
        F.concat(key, F.lit(","), cell))
    lines = orders.select(F.pmod(F.xxhash64("o_orderkey"), F.lit(8)).alias("part"), F.lit(1).alias("at"), line.alias("line"))
    heads = orders.sparkSession.range(8).select(
        F.col("id").alias("part"), F.lit(0).alias("at"), F.lit("o_orderkey,o_orderstatus").alias("line"))
    placed = lines.unionAll(heads).repartition("part").sortWithinPartitions("part", "at")
    placed.select("part", "line").write.partitionBy("part").text(path)


@query("q_csv_roundtrip", """
    SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name || '、"引用"' || chr(10) || '改行' AS n_name FROM nation
""")
def csv_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "nation")
    name = F.concat("n_name", F.lit('、"引用"\n改行')).alias("n_name")
    write_csv(t.nation.select("n_regionkey", name, "n_nationkey"), path)
    return read_csv_named(t.spark, path, ["n_nationkey", "n_name"])


@query("q_parquet_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def parquet_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "nation")
    replace_table(t.region, path)
    replace_table(t.nation, path)
    return t.spark.read.parquet(path)


@query("q_snapshot_upsert", UPSERT_SQL)
def snapshot_upsert(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "customer")
    target, updates = _upserted(t)
    write_snapshot(target, path)
    stored = read_snapshot(t.spark, path)
    write_snapshot(merging.upsert(stored, updates, ["c_custkey"], sequence="seq"), path)
    return read_snapshot(t.spark, path)
