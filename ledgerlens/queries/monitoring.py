"""Health queries: users of the event stream stand for datasets, their events for executions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.plans import monitor
from ledgerlens.operators.merging import ARRIVAL
from ledgerlens.queries.registry import NOW, Tables, query

from ledgerlens.session import scratch_path
from ledgerlens.sources.payloads import payload_schema

# Words the event types stand for.
STATE = """CASE event_type WHEN 'error' THEN 'Failed_data' WHEN 'view' THEN 'error' WHEN 'click' THEN 'my ERROR'
    WHEN 'signup' THEN '' ELSE 'SUCCESS' END"""
STATUS = "CASE WHEN value > 15 THEN 'disabled_x' WHEN value > 10 THEN 'DISABLED' WHEN value < 2 THEN 'Error_1' WHEN value < 3 THEN 'FAILED' ELSE 'VALID' END"
DATASETS = f"""(SELECT CAST(event_id AS VARCHAR) AS id, 'Dataset ' || event_id AS name,
    CAST(user_id AS INTEGER) AS card_count, CAST(user_id % 7 AS INTEGER) AS data_flow_count, upper(event_type) AS provider_type,
    {STATE} AS last_execution_state, {STATUS} AS dataset_status,
    CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) ELSE (epoch_us(ts) // 1000) END AS last_updated,
    ts, event_type FROM events)"""


def datasets(t: Tables) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    return t.events.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("Dataset "), "event_id").alias("name"),
        F.col("user_id").cast("int").alias("card_count"),
        (F.col("user_id") % 7).cast("int").alias("data_flow_count"),
        F.upper(kind).alias("provider_type"), F.expr(STATE).alias("last_execution_state"),
        F.expr(STATUS).alias("dataset_status"), F.col("ts"),
        F.when(kind == "signup", 0).when(kind == "view", seconds).otherwise(ms).alias("last_updated"))


def dataflows(t: Tables) -> DataFrame:
    at = F.when(F.col("last_updated") != 0, F.col("ts").cast("timestamp"))
    return datasets(t).select(
        "id", "name", F.col("provider_type").alias("database_type"), "last_execution_state",
        F.col("dataset_status").alias("status"), at.alias("last_execution_time"))


AGE = "CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - us) / 3600000000) AS BIGINT)"
HEALTH = f"""(SELECT *, CASE WHEN event_type = 'signup' THEN 'no_update'
        WHEN us < epoch_us(TIMESTAMP '2024-02-01' - INTERVAL 480 HOUR) THEN 'stale' ELSE 'ok' END AS verdict FROM (
    SELECT *, CASE event_type WHEN 'view' THEN last_updated * 1000000 ELSE last_updated * 1000 END AS us FROM {DATASETS} d
    WHERE card_count >= 20 AND data_flow_count >= 1))"""


def checked(t: Tables) -> DataFrame:
    return monitor.dataset_health(datasets(t), NOW, stale_hours=480, min_cards=20, min_dataflows=1)


@query("q_health_classify", f"""
    SELECT 'dataset' AS "type", verdict, id, name, provider_type, card_count,
        CASE WHEN verdict = 'stale' THEN strftime(make_timestamp(us) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') || ' JST' END AS last_seen,
        CASE WHEN verdict = 'stale' THEN {AGE} END AS hours_ago
    FROM {HEALTH} h
""")
def health_classify(t: Tables) -> DataFrame:
    return checked(t)


@query("q_health_summary", f"""
    SELECT count(*) AS total_checked, 0 AS failed_count, count(*) FILTER (verdict <> 'ok') AS stale_count,
        count(*) FILTER (verdict = 'ok') AS ok_count FROM {HEALTH} h
""")
def health_summary(t: Tables) -> DataFrame:
    return monitor.health_counts(checked(t))


@query("q_run_log", f"""
    SELECT 'night/1' AS run_id, 'dataset' AS check_type, (SELECT count(*) FROM {DATASETS} d) AS total_crawled,
        count(*) AS total_checked, 0 AS failed_count, count(*) FILTER (verdict <> 'ok') AS stale_count,
        count(*) FILTER (verdict = 'ok') AS ok_count, count(*) FILTER (verdict <> 'ok') AS total_alerts,
        count(*) FILTER (verdict <> 'ok') AS alert_rows FROM {HEALTH} h
""")
def run_log(t: Tables) -> DataFrame:
    """A run logged twice, as by a repeated job, is read once."""
    runs, alerts = scratch_path(t.spark, "runs"), scratch_path(t.spark, "alerts")
    for _ in range(2):
        monitor.log_check(t.spark, "dataset", checked(t), "{}", NOW, runs, alerts, "night/1", datasets(t))
    rows = monitor.read_log(t.spark, alerts).groupBy("run_id", "check_type").agg(F.count(F.lit(1)).alias("alert_rows"))
    return monitor.read_log(t.spark, runs).join(rows, ["run_id", "check_type"], "left").select(
        "run_id", "check_type", "total_crawled", "total_checked", "failed_count", "stale_count", "ok_count",
        "total_alerts", F.coalesce("alert_rows", F.lit(0)).alias("alert_rows"))


FLOW_FAILED = """upper(dataset_status) <> 'DISABLED' AND (contains(upper(last_execution_state), 'FAILED')
    OR contains(upper(last_execution_state), 'ERROR') OR contains(upper(dataset_status), 'FAILED') OR contains(upper(dataset_status), 'ERROR'))"""


@query("q_dataflow_health", f"""
    SELECT 'dataflow' AS "type", v AS verdict, id, name, provider_type AS database_type,
        CASE WHEN v = 'failed' AND last_execution_state = '' THEN dataset_status ELSE last_execution_state END AS last_execution_state,
        CASE WHEN v <> 'ok' THEN strftime(ran + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') || ' JST' END AS last_seen,
        CASE WHEN v = 'stale' THEN CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ran)) / 3600000000) AS BIGINT) END AS hours_ago
    FROM (SELECT *, CASE WHEN {FLOW_FAILED} THEN 'failed' WHEN ran < TIMESTAMP '2024-02-01' - INTERVAL 480 HOUR THEN 'stale' ELSE 'ok' END AS v
          FROM (SELECT *, CASE WHEN last_updated <> 0 THEN ts END AS ran FROM {DATASETS} d))
""")
def dataflow_health(t: Tables) -> DataFrame:
    return monitor.dataflow_health(dataflows(t), NOW, stale_hours=480)


FAILED = """(upper(dataset_status) NOT LIKE 'DISABLED%' AND (upper(last_execution_state) LIKE 'FAILED%'
    OR upper(last_execution_state) LIKE 'ERROR%' OR upper(dataset_status) LIKE 'ERROR%'))"""
FAILED_FLOW = FAILED[:-2] + " OR upper(dataset_status) LIKE 'FAILED%'))"


@query("q_alerts", f"""
    SELECT 'dataset' AS kind, id, name, last_execution_state AS state FROM {DATASETS} d WHERE {FAILED}
    UNION ALL SELECT 'dataflow', id, name, last_execution_state FROM {DATASETS} d WHERE {FAILED_FLOW}
""")
def alerts(t: Tables) -> DataFrame:
    ds, df = monitor.alerts(datasets(t), dataflows(t))
    shape = lambda f, kind: f.select(
        F.lit(kind).alias("kind"), "id", "name", F.col("last_execution_state").alias("state"))
    return shape(ds, "dataset").unionByName(shape(df, "dataflow"))


@query("q_auto_check", f"""
    SELECT d = 0 AND f = 0 AS all_ok, d AS failed_dataset_count, f AS failed_dataflow_count FROM
        (SELECT count(*) AS d FROM {DATASETS} d WHERE {FAILED} AND (lower(provider_type) = 'view' OR card_count >= 100)),
        (SELECT count(*) AS f FROM {DATASETS} d WHERE {FAILED_FLOW})
""".replace("d = 0 AND f = 0 AS all_ok", "CAST(d = 0 AND f = 0 AS INTEGER) AS all_ok"))
def auto_check(t: Tables) -> DataFrame:
    return monitor.auto_check(datasets(t), dataflows(t), "View", 100)[2]


@query("q_probe_candidates", f"""
    SELECT id, card_count, CAST(contains(upper(last_execution_state), 'FAILED') OR contains(upper(last_execution_state), 'ERROR') AS INTEGER) AS failed
    FROM {DATASETS} d WHERE lower(provider_type) = 'click' AND card_count >= 50 ORDER BY card_count DESC, id LIMIT 20
""")
def probe_candidates(t: Tables) -> DataFrame:
    return monitor.probe_candidates(datasets(t), "Click", 50).select("id", "card_count", "failed")


@query("q_list_datasets", f"""
    SELECT id, last_updated FROM {DATASETS} d WHERE lower(provider_type) = 'purchase' AND card_count >= 30
    ORDER BY last_updated DESC NULLS LAST, id LIMIT 200 OFFSET 100
""")
def list_datasets(t: Tables) -> DataFrame:
    rows, _ = monitor.list_datasets(datasets(t), "Purchase", 30, limit=200, offset=100)
    return rows.select("id", "last_updated")


@query("q_list_dataflows", f"""
    SELECT id, last_execution_state FROM (SELECT *, CASE WHEN last_updated <> 0 THEN ts END AS ran FROM {DATASETS} d)
    WHERE upper(last_execution_state) = 'SUCCESS' ORDER BY ran DESC NULLS LAST, id LIMIT 50
""")
def list_dataflows(t: Tables) -> DataFrame:
    rows, _ = monitor.list_dataflows(dataflows(t), "success", limit=50)
    return rows.select("id", "last_execution_state")


@query("q_provider_types", f"SELECT DISTINCT provider_type FROM {DATASETS} d WHERE provider_type <> ''")
def provider_types(t: Tables) -> DataFrame:
    return monitor.provider_types(datasets(t))


@query("q_state_distribution", f"""
    SELECT coalesce(nullif(last_execution_state, ''), 'UNKNOWN') AS last_execution_state, count(*) AS "count"
    FROM {DATASETS} d GROUP BY 1
""")
def state_distribution(t: Tables) -> DataFrame:
    return monitor.state_distribution(datasets(t))


@query("q_dataset_grid", f"""
    SELECT id, last_execution_state, card_count FROM {DATASETS} d WHERE contains(lower(name), 'set 1') AND provider_type = 'VIEW' AND card_count < 40
""")
def dataset_grid(t: Tables) -> DataFrame:
    rows = monitor.dataset_grid(datasets(t), "SET 1", "VIEW", "lt", 40, "card_count", "ASC")
    return rows.select("id", "last_execution_state", "card_count")


@query("q_export_datasets", f"""
    SELECT id AS "ID", name AS "Name", card_count AS "Card Count", provider_type AS "Provider Type", dataset_status AS "Dataset Status"
    FROM {DATASETS} d WHERE lower(provider_type) = 'error' AND card_count >= 100 AND contains(lower(name), '9')
""")
def export_datasets(t: Tables) -> DataFrame:
    none = lambda k: F.lit(None).cast("string").alias(k)
    missing = [none(k) for k in monitor.DATASET_EXPORT if k not in datasets(t).columns]
    rows = monitor.export_datasets(datasets(t).select("*", *missing), "Error", 100, " 9 ")
    return rows.select("ID", "Name", "Card Count", "Provider Type", "Dataset Status")


@query("q_export_dataflows", f"""
    SELECT id AS "ID", name AS "Name", dataset_status AS "Status", last_execution_state AS "Last Execution State"
    FROM {DATASETS} d WHERE upper(last_execution_state) = 'ERROR' AND contains(lower(name), '7')
""")
def export_dataflows(t: Tables) -> DataFrame:
    none = lambda k: F.lit(None).cast("string").alias(k)
    missing = [none(k) for k in monitor.DATAFLOW_EXPORT if k not in dataflows(t).columns]
    rows = monitor.export_dataflows(dataflows(t).select("*", *missing), "error", "7")
    return rows.select("ID", "Name", "Status", "Last Execution State")


# ---- nested payloads ----

@query("q_dataflow_ingest", """
    WITH ex AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max((epoch_us(ts) // 1000)) AS b FROM events GROUP BY 1)
    SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS status, 0 AS paused, '' AS database_type,
        CASE WHEN b IS NOT NULL THEN strftime(make_timestamp(b * 1000), '%Y-%m-%d %H:%M') END AS ran_at, state AS last_execution_state,
        c_nationkey AS execution_count, '' AS owner, 2 AS output_dataset_count, c_custkey || ',' || c_name AS output_dataset_ids
    FROM customer LEFT JOIN ex ON user_id = c_custkey
""")
def dataflow_ingest(t: Tables) -> DataFrame:
    outputs = F.array(
        F.struct(F.col("c_custkey").cast("string").alias("dataSourceId"), F.lit("x").alias("id")),
        F.struct(F.lit(None).cast("string").alias("dataSourceId"), F.col("c_name").alias("id")))
    stub = F.to_json(F.struct(
        F.col("c_custkey").cast("string").alias("databaseId"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("status"), F.col("c_nationkey").alias("executionCount"),
        outputs.alias("outputDatasets")))
    stubs = t.customer.select(F.from_json(stub, payload_schema("dataflow_stub")).alias("r")).select("r.*")
    runs = t.events.select(
        F.col("user_id").cast("string").alias("dataflowId"), F.col("event_id").alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("beginTime"), F.col("event_type").alias("state"))
    flows = monitor.normalise_dataflows(stubs, runs, NOW)
    return flows.select(
        "id", "name", "status", "paused", "database_type",
        F.date_format("last_execution_time", "yyyy-MM-dd HH:mm").alias("ran_at"),
        "last_execution_state", "execution_count", "owner", "output_dataset_count",
        F.array_join("output_dataset_ids", ",").alias("output_dataset_ids"))


@query("q_dataset_ingest", """
    WITH b AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_nationkey AS row_count,
        CASE WHEN c_nationkey < 8 THEN 'STANDARD' WHEN c_nationkey < 16 THEN '' ELSE c_mktsegment END AS provider,
        CASE WHEN c_nationkey % 3 = 0 THEN 'ACTIVE' WHEN c_nationkey % 3 = 1 THEN 'INACTIVE' ELSE '' END AS sched,
        CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE '' END AS state, 'VALID' AS status FROM customer),
    d AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, s_nationkey AS row_count,
        CASE WHEN s_nationkey < 12 THEN 'CONN' ELSE 'STANDARD' END AS provider, s_nationkey < 5 AS active,
        CASE WHEN s_nationkey < 20 THEN 'SUCCESS' ELSE '' END AS status FROM supplier)
    SELECT b.id, coalesce(d.name, b.name) AS name, coalesce(d.row_count, b.row_count) AS row_count,
        CASE WHEN d.id IS NOT NULL THEN d.provider WHEN b.provider IN ('', 'STANDARD') THEN '' ELSE b.provider END AS provider_type,
        CASE WHEN b.sched <> '' THEN b.sched WHEN d.active IS NULL THEN '' WHEN d.active THEN 'ACTIVE' ELSE 'INACTIVE' END AS schedule_state,
        CASE WHEN b.state <> '' THEN 'DISABLED' ELSE coalesce(nullif(d.status, ''), b.status) END AS dataset_status,
        coalesce(d.status, '') AS last_execution_state
    FROM b LEFT JOIN d USING (id)
""")
def dataset_ingest(t: Tables) -> DataFrame:
    nation = F.col("c_nationkey")
    found = F.to_json(F.struct(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"),
        nation.alias("rowCount"),
        F.when(nation < 8, "STANDARD").when(nation < 16, "").otherwise(F.col("c_mktsegment")).alias("dataProviderType"),
        F.when(nation % 3 == 0, True).when(nation % 3 == 1, False).alias("scheduleActive"),
        F.when(F.col("c_acctbal") < 0, "inactive").alias("state"), F.lit("VALID").alias("status")))
    supplier = F.col("s_nationkey")
    detail = F.to_json(F.struct(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"),
        supplier.alias("rowCount"), F.lit("STANDARD_OAUTH").alias("type"),
        F.struct(F.when(supplier < 12, "CONN").alias("name")).alias("dataProvider"),
        F.lit("STANDARD").alias("displayType"), (supplier < 5).alias("scheduleActive"),
        F.when(supplier < 20, "SUCCESS").alias("status")))
    parse = lambda df, c, name: df.select(
        F.from_json(c, payload_schema(name)).alias("r")).select("r.*")
    merged = monitor.merge_dataset_detail(
        monitor.normalise_datasets(parse(t.customer, found, "dataset_search")),
        monitor.normalise_details(parse(t.supplier, detail, "dataset_detail")))
    return monitor.dataset_table(merged, NOW).select(
        "id", "name", "row_count", "provider_type", "schedule_state", "dataset_status",
        "last_execution_state")


@query("q_schedule_merge", """
    SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(s_nationkey, c_nationkey) AS row_count, coalesce(CAST(s_suppkey AS VARCHAR), '') AS stream_id,
        CASE WHEN o_orderkey IS NULL THEN '' ELSE o_orderpriority END AS schedule_state,
        CASE WHEN c_acctbal < 0 THEN 'DISABLED' ELSE 'VALID' END AS dataset_status,
        coalesce(nullif(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, ''), CASE WHEN s_nationkey < 12 THEN 'SUCCESS' END, '') AS last_execution_state
    FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN orders ON o_orderkey = s_suppkey
""")
def schedule_merge(t: Tables) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    base = t.customer.select(
        text("c_custkey").alias("id"), F.col("c_nationkey").alias("row_count"), F.lit(0).alias("card_count"),
        F.lit("").alias("stream_id"), F.lit("").alias("schedule_state"),
        F.when(F.col("c_acctbal") < 0, "inactive").otherwise("").alias("state"), F.lit("VALID").alias("status"))
    detail = t.supplier.select(
        text("s_suppkey").alias("id"), F.col("s_nationkey").alias("row_count"), F.lit(1).alias("card_count"),
        F.when(F.col("s_nationkey") < 12, "SUCCESS").otherwise("").alias("status"), text("s_suppkey").alias("stream_id"),
        F.lit(2).alias(ARRIVAL))
    # The last record counts, though an earlier one is greater in every column.
    detail = detail.unionByName(detail.withColumns({
        "row_count": F.col("row_count") + 1000, "status": F.lit("ZZZ"), "stream_id": F.lit("zzz"), ARRIVAL: F.lit(1)}))
    state = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("")
    payload = F.to_json(F.struct(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("scheduleState"),
        F.struct(state.alias("currentState")).alias("lastExecution")))
    streams = t.orders.select(F.from_json(payload, payload_schema("stream")).alias("r")).select("r.*")
    streams = streams.withColumn(ARRIVAL, F.lit(2)).unionByName(streams.withColumns(
        {"scheduleState": F.lit("zzz"), ARRIVAL: F.lit(1)}))
    return monitor.merge_schedule(base, detail, streams).select(
        "id", "row_count", "stream_id", "schedule_state", "dataset_status", "last_execution_state")


@query("q_propagate_status", """
    WITH hits AS (SELECT unnest([CAST(user_id AS VARCHAR), CAST(user_id + 3 AS VARCHAR)]) AS id, event_type, ts, event_id FROM events
                  WHERE event_type <> 'view'),
    last AS (SELECT id, arg_max(event_type, (ts, CAST(event_id AS VARCHAR))) AS state FROM hits GROUP BY id)
    SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(state, c_mktsegment) AS last_execution_state
    FROM customer LEFT JOIN last ON last.id = CAST(c_custkey AS VARCHAR)
""")
def propagate_status(t: Tables) -> DataFrame:
    targets = t.customer.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("last_execution_state"))
    state = F.when(F.col("event_type") != "view", F.col("event_type"))
    out = F.array(F.col("user_id").cast("string"), (F.col("user_id") + 3).cast("string"), F.lit(""))
    flows = t.events.select(
        F.col("event_id").cast("string").alias("id"), state.alias("last_execution_state"),
        F.col("ts").alias("last_execution_time"), out.alias("output_dataset_ids"))
    return monitor.propagate_status(targets, flows)


@query("q_nested_records", """
    SELECT CAST(l_orderkey AS VARCHAR) AS "dataflowId", l_linenumber AS id, CAST(l_partkey % 2 = 0 AS INTEGER) AS failed,
        CASE WHEN l_partkey <> 0 THEN l_partkey / 1000.0 END AS duration_seconds, 2 AS input_count, 0 AS output_count, 7 AS error_count,
        array_to_string(list_filter(['first', 'm1', CASE WHEN l_linestatus <> 'O' THEN 'message ' || l_linestatus END, 'm3', 'm4', 'm5'],
            lambda x: x IS NOT NULL)[1:5], '|') AS error_messages
    FROM lineitem
""")
def nested_records(t: Tables) -> DataFrame:
    error = lambda localized, plain: F.struct(
        localized.cast("string").alias("localizedMessage"), plain.cast("string").alias("message"))
    none, blank = F.lit(None), F.lit("")
    status = F.when(F.col("l_linestatus") != "O", F.concat(F.lit("message "), "l_linestatus"))
    errors = F.array(
        error(F.lit("first"), F.lit("unused")), error(blank, F.lit("m1")), error(none, blank),
        error(blank, status), *[error(none, F.lit(f"m{i}")) for i in (3, 4, 5)])
    payload = F.to_json(F.struct(
        F.col("l_orderkey").cast("string").alias("dataflowId"), F.col("l_linenumber").alias("id"),
        F.when(F.col("l_partkey") % 2 == 0, True).alias("failed"),
        F.col("l_partkey").alias("beginTime"), (F.col("l_partkey") * 2).alias("endTime"),
        F.array("l_linestatus", "l_returnflag").alias("inputDataSources"), errors.alias("errors")))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_returnflag")
    runs = rows.select(F.from_json(payload, payload_schema("execution")).alias("r")).select("r.*")
    return monitor.execution_history(runs).select(
        "dataflowId", "id", "failed", F.col("duration_seconds").cast("double").alias("duration_seconds"),
        "input_count", "output_count", "error_count",
        F.array_join("error_messages", "|").alias("error_messages"))


@query("q_stream_detail", """
    SELECT o_orderkey AS stream_id, CAST(o_custkey AS VARCHAR) AS dataset_id, o_orderpriority AS dataset_type,
        CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE 0 END AS row_count, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS last_state,
        CASE WHEN o_orderstatus <> 'P' THEN 0 END AS last_errors, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS success_rows,
        CAST(o_orderstatus = 'O' AS INTEGER) AS is_running, CASE WHEN o_orderstatus = 'F' THEN 'owner ' || o_custkey END AS owner
    FROM orders
""")
def stream_detail(t: Tables) -> DataFrame:
    status, cust = F.col("o_orderstatus"), F.col("o_custkey")
    run = F.struct(F.col("o_orderpriority").alias("currentState"), cust.alias("rowsInserted"))
    payload = F.to_json(F.struct(
        F.col("o_orderkey").alias("id"),
        F.struct(cust.cast("string").alias("id"), F.col("o_orderpriority").alias("type"),
                 F.when(status == "F", cust).alias("rowCount"),
                 F.when(status == "F", F.struct(F.concat(F.lit("owner "), cust).alias("name"))).alias("owner"),
                 ).alias("dataSource"),
        F.when(status != "P", run).alias("lastExecution"),
        F.when(status == "F", run).alias("lastSuccessfulExecution"),
        F.when(status == "O", F.struct(cust.alias("executionId"))).alias("currentExecution")))
    streams = t.orders.select(F.from_json(payload, payload_schema("stream")).alias("r")).select("r.*")
    return monitor.stream_detail(streams).select(
        "stream_id", "dataset_id", "dataset_type", "row_count",
        F.col("last_execution.state").alias("last_state"),
        F.array_size("last_execution.errors").alias("last_errors"),
        F.col("last_successful_execution.rows_inserted").alias("success_rows"), "is_running", "owner")
