"""Health rules, alerts, nested payloads and table maintenance."""

import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerlens.plans import monitor
from ledgerlens.sources.files import read_csv, read_csv_named, read_json_lines, read_table, text_schema
from ledgerlens.sources.payloads import payload_schema
from ledgerlens.sources.sinks import append_table, input_sizes, read_snapshot, replace_table, write_snapshot

NOW = dt.datetime(2024, 2, 1, 12, tzinfo=dt.timezone.utc)
MS = int(NOW.timestamp() * 1000)
HOUR = 3_600_000


@pytest.fixture(scope="module")
def land(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")

    def write(name, *records):
        path = root / f"{name}-{len(list(root.iterdir()))}.json"
        path.write_text("\n".join(json.dumps(r) for r in records), encoding="utf-8")
        return read_json_lines(spark, str(path), payload_schema(name))

    return write


def test_dataset_search_defaults(land):
    """Only an id; everything; a null in place of the card counts."""
    got = monitor.normalise_datasets(land(
        "dataset_search", {"id": "invoices"},
        {"id": "shops", "name": "店舗", "rowCount": 31, "columnCount": 7, "cardInfo": {"cardCount": 4},
         "scheduleActive": False, "type": "csv", "state": "x"},
        {"id": "stock", "name": "在庫", "cardInfo": None, "scheduleActive": True, "dataProviderType": "sheet", "type": "csv"}))
    shown = ("name", "row_count", "column_count", "card_count", "schedule_state", "provider_type", "state")
    assert {r["id"]: tuple(r[c] for c in shown) for r in got.collect()} == {
        "invoices": ("", 0, 0, 0, "", "", ""), "shops": ("店舗", 31, 7, 4, "INACTIVE", "csv", "x"),
        "stock": ("在庫", 0, 0, 0, "ACTIVE", "sheet", "")}


def test_provider_choice_order(land):
    got = monitor.normalise_details(land(
        "dataset_detail",
        {"id": "1", "displayType": "STANDARD", "dataProvider": {"name": "ssh", "type": "t"}, "type": "root"},
        {"id": "2", "displayType": "", "dataProviderType": "STANDARD_OAUTH", "dataProvider": {"type": "STANDARD"}},
        {"id": "3"}))
    assert [r["provider_type"] for r in got.orderBy("id").collect()] == ["ssh", "STANDARD_OAUTH", ""]


def test_detail_merge(land):
    base = monitor.normalise_datasets(land(
        "dataset_search", {"id": "1", "name": "old", "rowCount": 5, "dataProviderType": "STANDARD", "status": "VALID"},
        {"id": "2", "name": "kept", "rowCount": 6, "dataProviderType": "STANDARD", "state": "inactive"}))
    detail = monitor.normalise_details(land(
        "dataset_detail", {"id": "1", "name": "", "rowCount": 9, "displayType": "mysql", "scheduleActive": True, "status": "SUCCESS"}))
    got = {r["id"]: r for r in monitor.dataset_table(monitor.merge_dataset_detail(base, detail), NOW).collect()}
    one, two = got["1"], got["2"]
    assert (one["name"], one["row_count"], one["provider_type"], one["schedule_state"], one["dataset_status"],
            one["last_execution_state"]) == ("old", 9, "mysql", "ACTIVE", "SUCCESS", "SUCCESS")
    assert (two["name"], two["provider_type"], two["dataset_status"], two["last_execution_state"]) == ("kept", "", "DISABLED", "")


def test_schedule_merge(land):
    base = monitor.normalise_datasets(land(
        "dataset_search", {"id": "1", "rowCount": 5, "status": "VALID"}, {"id": "2", "state": "Inactive", "scheduleActive": True},
        {"id": "3", "rowCount": 7, "streamId": "30"}))
    detail = monitor.normalise_details(land(
        "dataset_detail", {"id": "1", "rowCount": 9, "cardCount": 2, "streamId": "10", "status": "OLD"},
        {"id": "2", "status": "SUCCESS", "streamId": "99"}))
    streams = land("stream", {"id": 10, "scheduleState": "MANUAL", "lastExecution": {"currentState": "ERROR"}}, {"id": 11})
    got = {r["id"]: r for r in monitor.merge_schedule(base, detail, streams).collect()}
    pick = lambda r: (r["row_count"], r["card_count"], r["stream_id"], r["schedule_state"], r["dataset_status"], r["last_execution_state"])
    assert pick(got["1"]) == (9, 2, "10", "MANUAL", "VALID", "ERROR")
    assert pick(got["2"]) == (0, 0, "99", "ACTIVE", "DISABLED", "SUCCESS")
    assert pick(got["3"]) == (7, 0, "30", "", "", "")


def test_dataflow_latest_execution(land):
    stub = land("dataflow_stub", {"databaseId": "joins", "name": "売上結合", "status": "QUEUED",
                                  "outputDatasets": [{"dataSourceId": "a"}, {"id": "b"}]}, {"databaseId": "df_2"})
    runs = land("execution", {"dataflowId": "joins", "id": 1, "beginTime": 1500000000000, "state": "FAILED"},
                {"dataflowId": "joins", "id": 2, "beginTime": 1600000000000, "state": "SUCCESS"})
    got = {r["id"]: r for r in monitor.normalise_dataflows(stub, runs, NOW).collect()}
    assert got["joins"]["last_execution_state"] == "SUCCESS" and got["joins"]["status"] == "QUEUED"
    assert got["joins"]["output_dataset_ids"] == ["a", "b"] and got["df_2"]["last_execution_time"] is None
    assert got["df_2"]["output_dataset_count"] == 0 and got["df_2"]["paused"] is False


def test_execution_history(land):
    errors = [{"localizedMessage": "", "message": "m0"}, {"message": ""}] + [{"localizedMessage": f"l{i}"} for i in range(9)]
    got = monitor.execution_history(land(
        "execution", {"dataflowId": "d", "id": 1, "beginTime": 1000, "endTime": 3500, "errors": errors, "inputDataSources": ["a"]},
        {"dataflowId": "d", "id": 2, "beginTime": 0, "endTime": 5})).orderBy("id").collect()
    assert float(got[0]["duration_seconds"]) == 2.5 and got[0]["error_messages"] == ["m0", "l0", "l1", "l2", "l3"]
    assert (got[0]["error_count"], got[0]["input_count"]) == (11, 1)
    assert (got[1]["duration_seconds"], got[1]["error_messages"], got[1]["output_count"]) == (None, [], 0)


def test_stream_detail(land):
    run = {"executionId": 5, "currentState": "ERROR", "rowsInserted": 3}
    got = monitor.stream_detail(land(
        "stream", {"id": 1, "dataSource": {"id": "d", "type": "csv", "owner": {"name": "Ann"}}, "lastExecution": run,
                   "currentExecution": {"executionId": 6}}, {"id": 2})).orderBy("stream_id").collect()
    assert got[0]["last_execution"]["state"] == "ERROR" and got[0]["last_execution"]["errors"] == []
    assert (got[0]["owner"], got[0]["dataset_type"], got[0]["is_running"]) == ("Ann", "csv", True)
    assert (got[1]["last_execution"], got[1]["is_running"], got[1]["row_count"]) == (None, False, 0)


def datasets(spark, *items):
    base = {"id": "x", "name": "n", "provider_type": "", "card_count": None, "data_flow_count": None, "last_updated": None,
            "last_execution_state": None, "dataset_status": None}
    ddl = ("id string, name string, provider_type string, card_count int, data_flow_count int, last_updated bigint, "
           "last_execution_state string, dataset_status string")
    return spark.createDataFrame([tuple({**base, **i}.values()) for i in items], ddl)


def dataflows(spark, *items):
    base = {"id": "f", "name": "n", "status": None, "database_type": "", "last_execution_state": None, "last_execution_time": None,
            "output_dataset_ids": []}
    ddl = ("id string, name string, status string, database_type string, last_execution_state string, "
           "last_execution_time timestamp, output_dataset_ids array<string>")
    return spark.createDataFrame([tuple({**base, **i}.values()) for i in items], ddl)


def hours_ago(h):
    return NOW - dt.timedelta(hours=h)


def test_health_without_alerts(spark):
    ds = monitor.dataset_health(datasets(spark, {"id": "ds_1", "last_updated": MS}), NOW)
    df = monitor.dataflow_health(dataflows(spark, {"status": "SUCCESS", "last_execution_state": "SUCCESS", "last_execution_time": NOW}), NOW)
    assert tuple(monitor.health_counts(ds).first()) == (1, 0, 0, 1) == tuple(monitor.health_counts(df).first())


def test_dataset_health_verdicts(spark):
    table = datasets(
        spark, {"id": "old", "last_updated": MS - 30 * HOUR}, {"id": "seconds", "last_updated": MS // 1000 - 90_000},
        {"id": "never"}, {"id": "zero", "last_updated": 0}, {"id": "fresh", "last_updated": MS - HOUR},
        {"id": "edge", "last_updated": MS - 24 * HOUR})
    got = {r["id"]: (r["verdict"], r["hours_ago"], r["last_seen"]) for r in monitor.dataset_health(table, NOW).collect()}
    assert got == {"old": ("stale", 30, "2024-01-31 15:00 JST"), "seconds": ("stale", 25, "2024-01-31 20:00 JST"),
                   "never": ("no_update", None, None), "zero": ("no_update", None, None), "fresh": ("ok", None, None),
                   "edge": ("ok", None, None)}
    odd = table.filter("id = 'never'").withColumn("last_updated", F.lit("yesterday"))
    assert monitor.dataset_health(odd, NOW).first()["verdict"] == "ok"
    counts = monitor.health_counts(monitor.dataset_health(table, NOW)).first()
    assert counts["stale_count"] + counts["ok_count"] == counts["total_checked"] == 6
    assert monitor.dataset_health(table, NOW, min_cards=1).count() == 0
    assert monitor.dataset_health(table, NOW, provider="csv").count() == 0


def test_dataflow_health_verdicts(spark):
    table = dataflows(
        spark, {"id": "failed", "last_execution_state": "x_error", "last_execution_time": hours_ago(50)},
        {"id": "status", "status": "FAILED"}, {"id": "off", "status": "disabled", "last_execution_state": "FAILED"},
        {"id": "stale", "last_execution_state": "SUCCESS", "last_execution_time": hours_ago(25)}, {"id": "none"})
    got = {r["id"]: (r["verdict"], r["last_execution_state"], r["hours_ago"]) for r in monitor.dataflow_health(table, NOW).collect()}
    assert got == {"failed": ("failed", "x_error", None), "status": ("failed", "FAILED", None), "off": ("ok", "FAILED", None),
                   "stale": ("stale", "SUCCESS", 25), "none": ("ok", None, None)}


def test_alerts_and_listing(spark):
    ds = datasets(
        spark, {"id": "ledger", "provider_type": "sftp", "last_execution_state": "Failed_timeout", "card_count": 3},
        {"id": "quiet", "provider_type": "sheet"}, {"id": "broken", "dataset_status": "error: schema"},
        {"id": "retired", "last_execution_state": "FAILED", "dataset_status": "Disabled (x)"})
    df = dataflows(spark, {"id": "nightly", "status": "failed to start", "last_execution_state": "SUCCESS"},
                   {"id": "hourly", "last_execution_state": "SUCCESS"}, {"id": "new"})
    bad_ds, bad_df = monitor.alerts(ds, df)
    assert {r["id"] for r in bad_ds.collect()} == {"ledger", "broken"}
    assert {r["id"] for r in bad_df.collect()} == {"nightly"}
    page, total = monitor.list_datasets(ds, provider="SFTP")
    assert (total.first()[0], page.first()["id"]) == (1, "ledger")
    page, total = monitor.list_datasets(ds, limit=2, offset=2)
    assert (total.first()[0], page.count()) == (4, 2)
    assert monitor.list_dataflows(df, "success")[1].first()[0] == 2
    assert rows(monitor.provider_types(ds)) == [("sftp",), ("sheet",)]
    assert rows(monitor.state_distribution(ds)) == [("FAILED", 1), ("Failed_timeout", 1), ("UNKNOWN", 2)]


def test_auto_check(spark):
    ds = datasets(spark, {"id": "both", "name": "B", "provider_type": "mysql-ssh", "card_count": 90, "last_execution_state": "failed"},
                  {"id": "type", "provider_type": "MYSQL-SSH", "last_execution_state": "Error"},
                  {"id": "cards", "card_count": 40, "dataset_status": "ERROR"}, {"id": "few", "card_count": 39, "dataset_status": "ERROR"})
    failed, flows, verdict = monitor.auto_check(ds, dataflows(spark, {"id": "f"}))
    assert [r[0] for r in rows(failed)] == ["both", "cards", "type"] and flows.count() == 0
    assert tuple(verdict.first()) == (False, 3, 0)
    assert tuple(monitor.auto_check(ds.limit(0), dataflows(spark, {"id": "f"}))[2].first()) == (True, 0, 0)
    assert monitor.auto_check(ds, dataflows(spark, {"id": "f"}), provider=" ")[0].count() == 2
    probe = monitor.probe_candidates(ds, "mysql-ssh", 1).collect()
    assert [(r["id"], r["failed"]) for r in probe] == [("both", True)]


def test_propagation_takes_the_newest_run(spark):
    ds = datasets(spark, {"id": "1", "last_execution_state": "OLD"}, {"id": "2", "last_execution_state": "OLD"})
    df = dataflows(spark, {"id": "a", "last_execution_state": "FAILED", "last_execution_time": hours_ago(1), "output_dataset_ids": ["1", ""]},
                   {"id": "b", "last_execution_state": "SUCCESS", "last_execution_time": hours_ago(2), "output_dataset_ids": ["1"]},
                   {"id": "c", "last_execution_state": "", "last_execution_time": hours_ago(0), "output_dataset_ids": ["1", "2"]})
    assert rows(monitor.propagate_status(ds, df).select("id", "last_execution_state")) == [("1", "FAILED"), ("2", "OLD")]


def test_grids_and_exports(spark):
    ds = datasets(spark, {"id": "1", "name": "Ok", "card_count": 5}, {"id": "2", "name": "bad", "last_execution_state": "FAILED_X", "card_count": 1},
                  {"id": "3", "name": "old", "last_execution_state": "stale", "card_count": 9})
    assert [r["id"] for r in monitor.dataset_grid(ds, sort_by="card_count").collect()] == ["2", "3", "1"]
    assert [r["id"] for r in monitor.dataset_grid(ds, " O ", direction="gte", cards=6).collect()] == ["3"]
    full = ds.withColumns({c: F.lit(None).cast("string") for c in monitor.DATASET_EXPORT if c not in ds.columns})
    out = monitor.export_datasets(full, min_cards=2)
    assert out.columns == list(monitor.DATASET_EXPORT.values()) and [r["ID"] for r in out.collect()] == ["3", "1"]
    df = dataflows(spark, {"id": "f", "last_execution_state": "Error", "last_execution_time": NOW}, {"id": "g"})
    assert [r["id"] for r in monitor.dataflow_grid(df).collect()] == ["f", "g"]
    full = df.withColumns({c: F.lit(None).cast("string") for c in monitor.DATAFLOW_EXPORT if c not in df.columns})
    assert [r["ID"] for r in monitor.export_dataflows(full, "ERROR").collect()] == ["f"]


def test_a_run_logged_again_replaces_itself(spark, tmp_path):
    checked = monitor.dataset_health(datasets(spark, {"id": "1"}, {"id": "2", "last_updated": MS}), NOW).cache()
    log = lambda rows, run, kind="dataset": monitor.log_check(
        spark, kind, rows, '{"stale_hours": 24}', NOW, str(tmp_path / "runs"), str(tmp_path / "alerts"), run)
    for _ in range(2):
        log(checked, "7")
    first = log(checked, None)
    log(checked, first, "dataflow")
    read = lambda n: monitor.read_log(spark, str(tmp_path / n))
    assert rows(read("runs").select("run_id", "check_type", "total_crawled", "total_checked", "total_alerts")) == sorted([
        ("7", "dataset", 2, 2, 1), (first, "dataset", 2, 2, 1), (first, "dataflow", 2, 2, 1)])
    assert read("alerts").count() == 3
    assert json.loads(read("alerts").first()["details_json"])["id"] == "1"
    assert rows(monitor.run_summary(read("runs")).select("run_id", "total_alerts")) == [(first, 2), ("7", 1)]
    log(checked.filter("verdict = 'ok'"), "7")  # nothing is left of the alerts of before
    assert read("alerts").filter("run_id = '7'").count() == 0


# ---- readers and writers ----

def test_csv_reader_skips_malformed_and_keeps_text(spark, tmp_path):
    (tmp_path / "in.csv").write_text('b,a,extra\n01,"x\ny",1\n02,z,2,too,many\n03,"say ""hi""",3\n', encoding="utf-8")
    got = rows(read_csv_named(spark, str(tmp_path / "in.csv"), ["a", "b"]))
    assert ("x\ny", "01") in got and ('say "hi"', "03") in got
    with pytest.raises(ValueError, match="missing columns"):
        read_csv_named(spark, str(tmp_path / "in.csv"), ["nope"])
    strict = read_csv(spark, str(tmp_path / "in.csv"), text_schema(["b", "a", "extra"]))
    assert strict.cache().count() == 2


def test_tables_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read_table(spark, path) is None and read_snapshot(spark, path) is None
    one = spark.range(1)
    replace_table(spark.range(5), path)
    replace_table(one, path)
    append_table(one, path)
    assert read_table(spark, path).count() == 2
    snap = str(tmp_path / "s")
    assert write_snapshot(one, snap) == 1
    assert write_snapshot(read_snapshot(spark, snap).union(one), snap) == 2
    (tmp_path / "s" / "snapshot=3").mkdir()
    assert read_snapshot(spark, snap).count() == 2
    assert write_snapshot(one, snap) == 3
    assert rows(input_sizes({"a": one, "b": spark.range(3)})) == [("a", 1, 1), ("b", 3, 1)]
