"""Dataset and dataflow health: normalised payloads, stale and failed rules, alerts, exports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.casts import blank_to_null, epoch_timestamp
from ledgerlens.functions.periods import clock_text, hours_between
from ledgerlens.functions.predicates import (
    DISABLED, at_least, card_count_direction, contains_ci, equals_ci, failed_by_prefix,
    failed_by_word, severity, severity_exact, where_all,
)
from ledgerlens.operators.aggregates import distinct_values, state_counts
from ledgerlens.operators.merging import (
    arrival, best_per_key, first_wins, last_writes, lookup, overlay, propagate_last,
)
from ledgerlens.operators.ordering import asc, desc, top, window_of_rows
from ledgerlens.sources.sinks import replace_table

# ---- Fixed values: provider words without meaning, states, time zone, export headers. ----
PLAIN_PROVIDERS = ("STANDARD", "STANDARD_OAUTH")
INACTIVE = "INACTIVE"
ACTIVE = "ACTIVE"
ZONE, ZONE_SUFFIX = "Asia/Tokyo", " JST"
MAX_ERROR_MESSAGES = 5
PROBE_SIZE = 20
DATASET_EXPORT = {
    "id": "ID", "name": "Name", "row_count": "Row Count", "column_count": "Column Count",
    "card_count": "Card Count", "data_flow_count": "Dataflow Count",
    "provider_type": "Provider Type", "stream_id": "Stream ID",
    "schedule_state": "Schedule State", "dataset_status": "Dataset Status",
    "last_execution_state": "Last Execution State", "last_updated": "Last Updated",
    "updated_at": "Crawled At",
}
DATAFLOW_EXPORT = {
    "id": "ID", "name": "Name", "status": "Status", "paused": "Paused",
    "database_type": "Database Type", "last_execution_time": "Last Execution Time",
    "last_execution_state": "Last Execution State", "execution_count": "Execution Count",
    "owner": "Owner", "output_dataset_count": "Output Dataset Count", "updated_at": "Crawled At",
}
# ---- End of fixed values. ----


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


# ---- Payloads to tables ----

def schedule_word(active: Column) -> Column:
    return F.when(active, ACTIVE).when(~active, INACTIVE).otherwise("")


def provider_choice(preferred: Sequence[Column], fallback: Sequence[Column]) -> Column:
    """First meaningful candidate; if none, the first non-blank one in the fallback order."""
    telling = [F.when((c != "") & ~c.isin(*PLAIN_PROVIDERS), c) for c in preferred]
    return F.coalesce(*telling, *[blank_to_null(c) for c in fallback], F.lit(""))


def normalise_datasets(search: DataFrame) -> DataFrame:
    """Dataset search records with defaults for what is missing."""
    return search.select(
        _text("id").alias("id"), _text("name").alias("name"),
        _number("rowCount").alias("row_count"), _number("columnCount").alias("column_count"),
        _number("cardInfo.cardCount").alias("card_count"),
        _number("dataFlowCount").alias("data_flow_count"),
        F.coalesce("dataProviderType", "type", F.lit("")).alias("provider_type"),
        _text("streamId").alias("stream_id"),
        schedule_word(F.col("scheduleActive")).alias("schedule_state"),
        _text("status").alias("status"), _text("state").alias("state"),
        F.col("lastUpdated").alias("last_updated"),
    )


def normalise_details(detail: DataFrame) -> DataFrame:
    """Dataset detail records; the provider is the most telling of five candidates."""
    display, root, given = F.col("displayType"), F.col("type"), F.col("dataProviderType")
    kind, name = F.col("dataProvider.type"), F.col("dataProvider.name")
    return detail.select(
        "id", _text("name").alias("name"),
        _number("rowCount").alias("row_count"), _number("columnCount").alias("column_count"),
        _number("cardCount").alias("card_count"), _number("dataFlowCount").alias("data_flow_count"),
        provider_choice([display, given, name, root, kind], [display, given, kind, root])
        .alias("provider_type"),
        _text("streamId").alias("stream_id"),
        F.col("scheduleActive").alias("schedule_active"),
        _text("status").alias("status"), _text("state").alias("state"),
        F.col("lastUpdated").alias("last_updated"), *arrival(detail),
    )


def merge_dataset_detail(base: DataFrame, detail: DataFrame) -> DataFrame:
    """Search records overlaid by their details, with status words settled."""
    tagged = detail.withColumns({
        "__detail_status": F.col("status"), "__detail_provider": F.col("provider_type"),
    })
    merged = overlay(base, tagged, ["id"])
    provider = F.col("provider_type")
    plain = (provider == "") | provider.isin(*PLAIN_PROVIDERS)
    state = F.coalesce(blank_to_null(F.col("state")), F.col("status"), F.lit(""))
    schedule = F.coalesce(
        blank_to_null(F.col("schedule_state")), schedule_word(F.col("schedule_active"))
    )
    return merged.withColumns({
        "provider_type": F.when(plain, _text("__detail_provider")).otherwise(provider),
        "schedule_state": schedule,
        "dataset_status": F.when(F.upper(state) == INACTIVE, DISABLED).otherwise(state),
        "last_execution_state": _text("__detail_status"),
    }).drop("__detail_status", "__detail_provider", "schedule_active")


def merge_schedule(base: DataFrame, detail: DataFrame, streams: DataFrame) -> DataFrame:
    """Search records with counts from their details and states from their streams' schedules.

    The state of the stream's last execution wins over the status of the details. Of several
    details of a record, or records of a stream, the last to arrive counts.
    """
    d = last_writes(detail, ["id"]).select(
        "id", F.col("row_count").alias("__rows"), F.col("card_count").alias("__cards"),
        F.col("status").alias("__status"), blank_to_null(F.col("stream_id")).alias("__stream"),
    )
    s = last_writes(stream_detail(streams), ["stream_id"]).select(
        F.col("stream_id").cast("string").alias("__stream_id"), F.lit(True).alias("__found"),
        F.col("last_execution.state").alias("__state"), F.col("schedule_state").alias("__schedule"),
    )
    state = F.coalesce(blank_to_null(F.col("state")), F.col("status"), F.lit(""))
    # Most records have no stream: a lookup spreads them, and any stream of very many records.
    return lookup(base.join(d, "id", "left"), s, "__stream", "__stream_id").withColumns({
        "row_count": F.coalesce("__rows", "row_count"),
        "card_count": F.coalesce("__cards", "card_count"),
        "stream_id": F.coalesce("__stream", "stream_id"),
        "schedule_state": F.when(F.col("__found"), F.col("__schedule")).otherwise(F.col("schedule_state")),
        "dataset_status": F.when(F.upper(state) == INACTIVE, DISABLED).otherwise(state),
        "last_execution_state": F.coalesce(
            blank_to_null(F.col("__state")), blank_to_null(F.col("__status")), F.lit("")),
    }).drop("__stream", "__found", "__state", "__schedule", "__rows", "__cards", "__status")


def dataset_table(merged: DataFrame, crawled_at: dt.datetime) -> DataFrame:
    """The stored dataset table: epoch times become timestamps."""
    return merged.select(
        "id", "name", "row_count", "column_count", "card_count", "data_flow_count",
        "provider_type", "stream_id", "schedule_state", "dataset_status", "last_execution_state",
        epoch_timestamp(F.col("last_updated")).alias("last_updated"),
        F.lit(crawled_at).cast("timestamp").alias("updated_at"),
    )


def latest_executions(executions: DataFrame) -> DataFrame:
    """Newest execution per dataflow."""
    rows = executions.select("dataflowId", "id", "beginTime", "state")
    return best_per_key(rows, ["dataflowId"], [F.col("beginTime"), F.col("id")])


def normalise_dataflows(
    stubs: DataFrame, executions: DataFrame, crawled_at: dt.datetime
) -> DataFrame:
    """Dataflows with the time and state of their newest execution and their output datasets."""
    latest = latest_executions(executions).select(
        F.col("dataflowId").alias("databaseId"), F.col("beginTime").alias("__begin"),
        F.coalesce("state", F.lit("UNKNOWN")).alias("last_execution_state"),
    )
    outputs = F.coalesce("outputDatasets", F.array().cast(stubs.schema["outputDatasets"].dataType))
    ids = F.transform(outputs, lambda o: F.coalesce(o["dataSourceId"], o["id"], F.lit("")))
    return stubs.join(latest, "databaseId", "left").select(
        _text("databaseId").alias("id"), _text("name").alias("name"),
        _text("status").alias("status"),
        F.coalesce("paused", F.lit(False)).alias("paused"),
        _text("dataFlowType").alias("database_type"),
        F.when(F.col("__begin") != 0, F.timestamp_millis("__begin")).alias("last_execution_time"),
        "last_execution_state",
        _number("executionCount").alias("execution_count"),
        _text("ownedByName").alias("owner"),
        F.size(outputs).alias("output_dataset_count"),
        ids.alias("output_dataset_ids"),
        F.lit(crawled_at).cast("timestamp").alias("updated_at"),
    )


def execution_history(executions: DataFrame) -> DataFrame:
    """Executions with duration, input and output counts, and up to five error messages."""
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    message = lambda e: F.coalesce(
        blank_to_null(e["localizedMessage"]), blank_to_null(e["message"])
    )
    said = F.filter(F.transform("errors", message), lambda m: m.isNotNull())
    return executions.select(
        "dataflowId", "id", "state",
        F.coalesce("failed", F.lit(False)).alias("failed"),
        F.col("activationType").alias("activation_type"),
        F.col("beginTime").alias("begin_time"), F.col("endTime").alias("end_time"),
        duration_seconds(F.col("beginTime"), F.col("endTime")).alias("duration_seconds"),
        _number("totalRowsRead").alias("total_rows_read"),
        _number("totalBytesRead").alias("total_bytes_read"),
        _number("totalRowsWritten").alias("total_rows_written"),
        _number("totalBytesWritten").alias("total_bytes_written"),
        size(F.col("inputDataSources")).alias("input_count"),
        size(F.col("outputDataSources")).alias("output_count"),
        size(F.col("errors")).alias("error_count"),
        F.coalesce(F.slice(said, 1, MAX_ERROR_MESSAGES), F.array().cast("array<string>"))
        .alias("error_messages"),
        F.col("dataFlowVersion").alias("dataflow_version"),
    )


def duration_seconds(begin_ms: Column, end_ms: Column) -> Column:
    return F.when((begin_ms != 0) & (end_ms != 0), (end_ms - begin_ms) / 1000.0)


def stream_detail(streams: DataFrame) -> DataFrame:
    """Schedule, owner and the last, last successful and current execution of a stream."""
    source = lambda c: F.col(f"dataSource.{c}")

    def run(name: str, with_errors: bool) -> Column:
        r = F.col(name)
        parts = [
            r["executionId"].alias("execution_id"), r["currentState"].alias("state"),
            r["startedAt"].alias("started_at"), r["endedAt"].alias("ended_at"),
            r["rowsInserted"].alias("rows_inserted"),
        ]
        if with_errors:
            parts += [
                r["bytesInserted"].alias("bytes_inserted"),
                F.coalesce(r["errors"], F.array().cast("array<string>")).alias("errors"),
            ]
        return F.when(r.isNotNull(), F.struct(*parts))

    return streams.select(
        F.col("id").alias("stream_id"),
        source("id").alias("dataset_id"), source("name").alias("dataset_name"),
        F.coalesce(source("dataProviderType"), source("type"), F.lit("")).alias("dataset_type"),
        source("status").alias("dataset_status"),
        F.coalesce(source("rowCount"), F.lit(0)).alias("row_count"),
        F.coalesce(source("columnCount"), F.lit(0)).alias("column_count"),
        F.col("scheduleExpression").alias("schedule_expression"),
        F.col("scheduleState").alias("schedule_state"),
        F.col("updateMethod").alias("update_method"),
        F.col("dataSource.owner.name").alias("owner"),
        run("lastExecution", True).alias("last_execution"),
        run("lastSuccessfulExecution", False).alias("last_successful_execution"),
        F.col("currentExecutionState").alias("current_execution_state"),
        F.col("currentExecution").isNotNull().alias("is_running"),
        source("tags").alias("tags"),
        source("scheduleActive").alias("schedule_active"), *arrival(streams),
    )


def propagate_status(datasets: DataFrame, dataflows: DataFrame) -> DataFrame:
    """Each dataset takes the state of the newest dataflow run that writes it."""
    return propagate_last(
        datasets, "id", "last_execution_state", dataflows, F.col("output_dataset_ids"),
        F.col("last_execution_state"),
        [F.col("last_execution_time"), F.col("id")],
    )


# ---- Health ----

def dataset_health(
    datasets: DataFrame, now: dt.datetime, stale_hours: int = 24, min_cards: int = 0,
    provider: str = "", min_dataflows: int = 0,
) -> DataFrame:
    """Checked datasets with verdict ok, stale or no_update.

    last_updated is an epoch number; a text that is no number counts as a recent update.
    """
    wanted = [
        *at_least(F.col("card_count"), min_cards, null_is_zero=True),
        *([equals_ci(F.col("provider_type"), provider)] if provider else []),
        *at_least(F.col("data_flow_count"), min_dataflows, null_is_zero=True),
    ]
    raw = F.col("last_updated")
    at = epoch_timestamp(raw.try_cast("bigint"))
    never = raw.isNull() | raw.cast("string").isin("", "0")
    moment = F.lit(now).cast("timestamp")
    limit = F.lit(now - dt.timedelta(hours=stale_hours)).cast("timestamp")
    verdict = F.when(never, "no_update").when(at < limit, "stale").otherwise("ok")
    return where_all(datasets, wanted).select(
        F.lit("dataset").alias("type"), verdict.alias("verdict"), "id", "name",
        "provider_type", "card_count",
        F.when(verdict == "stale", clock_text(at, ZONE, ZONE_SUFFIX)).alias("last_seen"),
        F.when(verdict == "stale", hours_between(at, moment)).alias("hours_ago"),
    )


def dataflow_health(dataflows: DataFrame, now: dt.datetime, stale_hours: int = 24) -> DataFrame:
    """Dataflows with verdict failed, stale or ok; failed is decided first."""
    at, state = F.col("last_execution_time"), F.col("last_execution_state")
    moment = F.lit(now).cast("timestamp")
    limit = F.lit(now - dt.timedelta(hours=stale_hours)).cast("timestamp")
    failed = failed_by_word(state, F.col("status"))
    verdict = F.when(failed, "failed").when(at < limit, "stale").otherwise("ok")
    shown = F.when(verdict == "failed", F.coalesce(blank_to_null(state), F.col("status")))
    return dataflows.select(
        F.lit("dataflow").alias("type"), verdict.alias("verdict"), "id", "name", "database_type",
        F.when(verdict == "ok", state).otherwise(F.coalesce(shown, state)).alias("last_execution_state"),
        F.when(verdict != "ok", clock_text(at, ZONE, ZONE_SUFFIX)).alias("last_seen"),
        F.when(verdict == "stale", hours_between(at, moment)).alias("hours_ago"),
    )


def health_counts(checked: DataFrame) -> DataFrame:
    """Counters of one check; a dataset never updated counts as stale."""
    v = F.col("verdict")
    return checked.agg(
        F.count(F.lit(1)).alias("total_checked"),
        F.count_if(v == "failed").alias("failed_count"),
        F.count_if(v.isin("stale", "no_update")).alias("stale_count"),
        F.count_if(v == "ok").alias("ok_count"),
    )


def _of_run(path: str, run_id: str, check_type: str) -> str:
    return f"{path}/run_id={quote(run_id, safe='')}/check_type={check_type}"


def log_check(
    spark: SparkSession, check_type: str, checked: DataFrame, filters_json: str,
    checked_at: dt.datetime, runs_path: str, alerts_path: str, run_id: str | None = None,
    crawled: DataFrame | None = None,
) -> str:
    """Log the counters of a run, and its alerts, one row each, beside them; returns the run's id.

    Alerts are rows keyed by run rather than one JSON text, so that a bad day with millions of
    alerts is still written in parallel; each row carries its details as JSON. A run's rows have
    folders of their own, which a run logged again replaces, so a rerun does not double anything. By
    default the time of the check is the run's id. total_crawled counts the records that
    were fetched, of which the checked ones passed the filters.
    """
    run = run_id or checked_at.strftime("%Y%m%dT%H%M%S.%f")
    stamp = F.lit(checked_at).cast("timestamp").alias("checked_at")
    fetched = (checked if crawled is None else crawled).agg(F.count(F.lit(1)).alias("total_crawled"))
    counts = health_counts(checked).select(
        fetched.scalar().alias("total_crawled"), "*",
        (F.col("total_checked") - F.col("ok_count")).alias("total_alerts"),
        F.lit(filters_json).alias("filters_json"), stamp)
    # The alerts come first: a run with counters is complete.
    details = F.to_json(F.struct(*[F.col(c) for c in checked.columns])).alias("details_json")
    replace_table(checked.filter(F.col("verdict") != "ok").select(stamp, details),
                  _of_run(alerts_path, run, check_type))
    replace_table(counts, _of_run(runs_path, run, check_type))
    return run


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The logged rows of all runs, with run_id and check_type, both as text."""
    found = spark.read.parquet(path)
    kinds = [f"`{f.name}` {'string' if f.name in ('run_id', 'check_type') else f.dataType.simpleString()}"
             for f in found.schema]
    return spark.read.schema(", ".join(kinds)).parquet(path)


def run_summary(runs: DataFrame) -> DataFrame:
    """Alerts of each run over all its checks, and the checks as a list of counters."""
    per = F.struct("check_type", "total_crawled", "total_checked", "ok_count", "failed_count", "stale_count")
    return runs.groupBy("run_id").agg(
        F.sum("total_alerts").alias("total_alerts"), F.sort_array(F.collect_list(per)).alias("checks"))


# ---- Alerts and listings over the stored tables ----

def failed_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.filter(failed_by_prefix(F.col("last_execution_state"), F.col("dataset_status")))


def failed_dataflows(dataflows: DataFrame) -> DataFrame:
    return dataflows.filter(
        failed_by_prefix(F.col("last_execution_state"), F.col("status"), status_may_fail=True)
    )


def alerts(datasets: DataFrame, dataflows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        failed_datasets(datasets).select(
            "id", "name", "provider_type", "last_execution_state", "card_count"),
        failed_dataflows(dataflows).select("id", "name", "last_execution_state", "status"),
    )


def auto_check(
    datasets: DataFrame, dataflows: DataFrame, provider: str = "mysql-ssh", min_cards: int = 40
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Failed datasets by provider or by card count without repeats, failed dataflows, verdict."""
    failed = failed_datasets(datasets)
    by_type = failed.filter(equals_ci(F.col("provider_type"), provider) if provider.strip() else F.lit(False))
    by_cards = failed.filter(F.col("card_count") >= min_cards)
    merged = first_wins([by_type.select("id", "name"), by_cards.select("id", "name")], ["id"])
    flows = failed_dataflows(dataflows).select("id", "name")
    tagged = merged.select(F.lit(1).alias("d")).unionByName(flows.select(F.lit(0).alias("d")))
    verdict = tagged.agg(
        (F.count(F.lit(1)) == 0).alias("all_ok"),
        F.count_if(F.col("d") == 1).alias("failed_dataset_count"),
        F.count_if(F.col("d") == 0).alias("failed_dataflow_count"),
    )
    return merged, flows, verdict


def probe_candidates(datasets: DataFrame, provider: str, min_cards: int) -> DataFrame:
    """The largest datasets meeting the check's condition, and whether each has failed."""
    hits = datasets.filter(
        equals_ci(F.col("provider_type"), provider) & (F.col("card_count") >= min_cards)
    )
    cols = ["id", "name", "provider_type", "card_count", "last_execution_state"]
    best = top(hits.select(*cols), PROBE_SIZE, F.col("card_count").desc_nulls_last(), F.asc("id"))
    return best.withColumn("failed", failed_by_word(F.col("last_execution_state"), F.lit("")))


def list_datasets(
    datasets: DataFrame, provider: str = "", min_cards: int = 0, limit: int = 5000, offset: int = 0
) -> tuple[DataFrame, DataFrame]:
    wanted = [*([equals_ci(F.col("provider_type"), provider)] if provider else []),
              *at_least(F.col("card_count"), min_cards, null_is_zero=False)]
    hits = where_all(datasets, wanted)
    order = [desc("last_updated"), asc("id")]
    return window_of_rows(hits, order, offset, limit), hits.agg(F.count(F.lit(1)).alias("total"))


def list_dataflows(
    dataflows: DataFrame, state: str = "", limit: int = 5000, offset: int = 0
) -> tuple[DataFrame, DataFrame]:
    wanted = [equals_ci(F.col("last_execution_state"), state)] if state else []
    hits = where_all(dataflows, wanted)
    order = [desc("last_execution_time"), asc("id")]
    return window_of_rows(hits, order, offset, limit), hits.agg(F.count(F.lit(1)).alias("total"))


def provider_types(datasets: DataFrame) -> DataFrame:
    return distinct_values(datasets, "provider_type")


def state_distribution(df: DataFrame, state: str = "last_execution_state") -> DataFrame:
    return state_counts(df, F.col(state), state)


def dataset_grid(
    datasets: DataFrame, text: str = "", provider: str = "", direction: str | None = None,
    cards: int = 0, sort_by: str = "last_updated", sort_order: str = "DESC",
) -> DataFrame:
    """The monitoring grid: filtered, failed first, then by the chosen column."""
    wanted = [*([contains_ci(F.col("name"), text)] if text.strip() else []),
              *([F.col("provider_type") == provider] if provider else []),
              *card_count_direction(F.col("card_count"), direction, cards)]
    return where_all(datasets, wanted).orderBy(
        severity(F.col("last_execution_state")), *_chosen(sort_by, sort_order))


def dataflow_grid(
    dataflows: DataFrame, text: str = "", sort_by: str = "last_execution_time",
    sort_order: str = "DESC",
) -> DataFrame:
    wanted = [contains_ci(F.col("name"), text)] if text.strip() else []
    return where_all(dataflows, wanted).orderBy(
        severity_exact(F.col("last_execution_state")), *_chosen(sort_by, sort_order))


def _chosen(sort_by: str, sort_order: str) -> list[Column]:
    c = F.col(sort_by)
    first = c.asc_nulls_first() if sort_order.upper() == "ASC" else c.desc_nulls_last()
    return [first, F.col("id").asc()]


def export_datasets(
    datasets: DataFrame, provider: str = "", min_cards: int = 0, text: str = ""
) -> DataFrame:
    wanted = [*([equals_ci(F.col("provider_type"), provider)] if provider else []),
              *at_least(F.col("card_count"), min_cards, null_is_zero=False),
              *([contains_ci(F.col("name"), text)] if text.strip() else [])]
    ordered = where_all(datasets, wanted).orderBy(F.col("card_count").desc_nulls_last(), F.asc("id"))
    return ordered.select(*[F.col(k).alias(v) for k, v in DATASET_EXPORT.items()])


def export_dataflows(dataflows: DataFrame, state: str = "", text: str = "") -> DataFrame:
    wanted = [*([equals_ci(F.col("last_execution_state"), state)] if state else []),
              *([contains_ci(F.col("name"), text)] if text.strip() else [])]
    ordered = where_all(dataflows, wanted).orderBy(
        F.col("last_execution_time").desc_nulls_last(), F.asc("id"))
    return ordered.select(*[F.col(k).alias(v) for k, v in DATAFLOW_EXPORT.items()])
