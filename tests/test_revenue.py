"""The revenue report on small domain inputs, written to CSV and read back."""

import csv
import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import asc
from ledgerlens.plans import cards, revenue
from ledgerlens.sources.files import input_files, load_inputs, read_config
from ledgerlens.sources.sinks import StepCounts

REF = "2025-05-10"
P = str(revenue.PROJECT_ID)


def issue(**given):
    return {"id": "1", "projectId": P, "issueKey": "K-1", "issueType_name": "2024／A", "status_name": "完了",
            "summary": "s", "customFields5_value": "2025-04-10", **given}


ISSUES = [
    issue(id="1", customFields2_value="12,000", customFields6_value_name="佐藤", customFields7_value="12.5"),
    issue(id="2", customFields2_value="500", customFields5_value="2025/4/1", parentIssueId="1"),
    issue(id="3", customFields2_value="未定", customFields5_value="", parentIssueId="1"),
    issue(id="4", customFields2_value="12.5", customFields5_value="soon", parentIssueId="1"),
    issue(id="5", customFields2_value="7", customFields5_value="2025-03-31"),
    issue(id="6", issueType_name="X2024／A"), issue(id="7", issueType_name="２０２４／A"),
    issue(id="8", projectId="99"),
    issue(id="9", customFields2_value="100", customFields5_value="2025-04-10", status_name="未対応", parentIssueId="2"),
    issue(id="10", customFields2_value="1", customFields5_value="2025-08-01", summary="d", status_name="請求済"),
    issue(id="10", customFields2_value="2", customFields5_value="2025-08-01", summary="d", status_name="請求済"),
]
EXCEL = [
    {"id": "20", "projectId": P, "summary": "", "customFields5_value": "2025-01-15", "customFields2_value": "50",
     "status_name": "完了", "customFields8_value": "4", "担当者９": "山本", "担当者９ウェイト": "9"},
    {"id": "21", "projectId": P, "summary": "WEB保守費用"}, {"id": "22", "projectId": P, "summary": "チャットボット月額"},
    {"id": "23", "projectId": "99", "summary": "other"},
]
FEES = [
    {"商品名": "保守", "加盟店名": "A", "ERAWAN": "3267", "単価（円/税抜）": "1,000", "開始年月": "2024年12月", "終了年月": "2025年02月"},
    {"商品名": "保守", "加盟店名": "B", "ERAWAN": "4034", "単価（円/税抜）": "2000", "開始年月": "202504", "終了年月": ""},
    {"商品名": "保守", "加盟店名": "C", "ERAWAN": "55", "単価（円/税抜）": "1", "開始年月": "202505", "終了年月": "202501"},
    {"商品名": "保守", "加盟店名": "D", "ERAWAN": "55", "単価（円/税抜）": "1", "開始年月": "未定", "終了年月": ""},
    {"商品名": "", "加盟店名": "E", "ERAWAN": "55", "単価（円/税抜）": "1", "開始年月": "202501", "終了年月": ""},
]
SUBS = [{"加盟店名": "Z", "単価（円/税抜）": "300", "請求開始年月": "2025年03月", "終了年月": "2025年03月"}]
CALENDAR = [{"calendar_year": str(y), "calendar_month": f"{m:02d}", "calendar_date": f"{d:02d}"}
            for y in (2023, 2024, 2025) for m in range(1, 13) for d in (1, 2)]
BUDGET = [{"year": "2025", "category": "c", **{str(m): "" if m == 2 else str(m) for m in range(1, 13)}}]
HISTORY = [{"_COLUMN_1": str(y), **{f"{m}月": "10.5" for m in range(1, 13)}} for y in (2024, 2025)]
PROJECTS = [{"id": P, "projectKey": "K", "name": "P1", "extra": "x"}, {"id": "99", "projectKey": "L", "name": "P2"}]
DATA = {"issues": ISSUES, "projects": PROJECTS, "excel_tasks": EXCEL, "monthly_fees": FEES,
        "subscriptions": SUBS, "calendar": CALENDAR, "budget": BUDGET, "history": HISTORY}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("入力")
    for name, records in DATA.items():
        columns = list(dict.fromkeys([*revenue.INPUT_COLUMNS[name], *[k for r in records for k in r]]))
        with open(root / f"{name} 表.csv", "w", encoding="utf-8", newline="") as f:
            out = csv.DictWriter(f, columns)
            out.writeheader()
            out.writerows(records)
    return str(root)


def test_config_names_the_files(spark, tmp_path):
    doc = {"name": "r", "cards": [{"id": 1}], "inputs": [{"name": "issues", "file": "i.csv", "id": "x"}]}
    (tmp_path / "config.json").write_text(json.dumps(doc, ensure_ascii=False, indent=1), encoding="utf-8")
    config = read_config(spark, str(tmp_path / "config.json"))
    assert config == doc and input_files(config) == {"issues": "i.csv"}


FILES = {name: f"{name} 表.csv" for name in DATA}


@pytest.fixture(scope="module")
def sources(spark, folder):
    return load_inputs(spark, folder, FILES, revenue.INPUT_COLUMNS)


@pytest.fixture(scope="module")
def tasks(spark, sources):
    return revenue.task_list(sources, dt.date(2025, 5, 10), revenue.RevenueConfig()).cache()


@pytest.fixture(scope="module")
def report(sources):
    return revenue.final_output(sources, REF).cache()


def test_missing_input_is_named(spark, folder):
    with pytest.raises(ValueError, match="history"):
        load_inputs(spark, folder, {k: v for k, v in FILES.items() if k != "history"}, revenue.INPUT_COLUMNS)
    with pytest.raises(FileNotFoundError, match="budget"):
        load_inputs(spark, folder, {**FILES, "budget": "nowhere.csv"}, revenue.INPUT_COLUMNS)


def test_kept_tasks(tasks):
    got = {(r["課題ID"], r["課題タイトル"], r["加盟店名"]) for r in tasks.collect()}
    issues = {(i, "s", None) for i in (1, 2, 3, 4, 9)} | {(10, "d", None)}
    fees = {(2, "保守(01月分)", "A"), (3, "保守(02月分)", "A"), (4, "保守(04月分)", "B"), (5, "保守(05月分)", "B")}
    assert got == issues | {(20, None, None)} | fees | {(1, "サブスクLP_月額費用(03月分)", "Z")}
    assert tasks.count() == 12 + 1


def test_fee_rows_are_numbered_before_the_date_floor(tasks):
    row = tasks.filter("`加盟店名` = 'A' AND `課題ID` = 2").first()
    assert row["請求日"] == dt.date(2025, 1, 1) and row["期限日"] == dt.date(2025, 1, 31)
    assert row["ERAWANコード"] == "3267／加盟店用WEB保守月額" and row["担当者①のウェイト"] == 10
    assert row["税抜費用（int）"] == 1000 and row["ステータス名"] == "完了" and row["プロジェクト名"] == "P1"


def test_cost_routes_and_casts(tasks):
    by_id = {r["課題ID"]: r for r in tasks.filter("`加盟店名` IS NULL").collect()}
    assert [by_id[i]["税抜費用（int）"] for i in (1, 2, 3, 4)] == [12000, 500, None, None]
    assert by_id[1]["担当者①のウェイト"] == 13 and by_id[20]["担当者②のウェイト"] == 4
    assert by_id[20]["担当者⑨のウェイト"] == 9 and by_id[20]["親/子課題"] == "親課題" and by_id[2]["親/子課題"] == "子課題"
    assert by_id[1]["課題URL"].endswith('target="_blank">K-1</a>')
    assert [by_id[i]["請求日（期）"] for i in (1, 4, 10)] == ["今期", "請求日未入力", "39.0期"]


def test_output_schema_has_55_typed_columns(report):
    assert [(f.name, f.dataType.simpleString()) for f in report.schema] == revenue.OUTPUT_SCHEMA
    assert len(report.columns) == 55


def test_row_counts_per_category(report, tasks):
    counts = {r[0]: r[1] for r in report.groupBy("BLカテゴリ").count().collect()}
    # Two tasks equal in date, id and title see both running totals; history has the 12 months of 2024.
    assert counts == {"課題リスト": tasks.count() + 2 + 12, "ウェイト別課題": 9 * tasks.count(), "予算": 12}


def test_running_totals(report):
    period = report.filter("`BLカテゴリ` = '課題リスト' AND `請求日（期）` = '今期'")
    got = [(str(r["請求日"]), r["課題ID"], r["累計売上額（見込み）"], r["累計売上額（実績）"])
           for r in period.orderBy("請求日", "課題ID").collect()]
    assert got == [
        ("2025-01-01", 2, 1000, 1000), ("2025-01-15", 20, 1050, 1050), ("2025-02-01", 3, 2050, 2050),
        ("2025-03-01", 1, 2350, 2350), ("2025-04-01", 2, 2850, 2850), ("2025-04-01", 4, 4850, 4850),
        ("2025-04-10", 1, 16850, 16850), ("2025-04-10", 9, 16950, None), ("2025-05-01", 5, 18950, 18850)]


def test_child_counts(report):
    got = {(r["課題ID"], r["子課題数"]) for r in report.filter("`子課題数` IS NOT NULL").collect()}
    assert got == {(1, 3), (2, 1)}


def test_weight_rows(report):
    nine = report.filter("`BLカテゴリ` = 'ウェイト別課題' AND `課題ID` = 20")
    got = {r["担当者種別"]: (r["担当者"], r["種"], r["ウェイト"]) for r in nine.collect()}
    assert len(got) == 9 and got["担当者⑨"] == ("山本", "担当者⑨のウェイト", 9)
    assert got["担当者②"] == (None, "担当者②のウェイト", 4) and got["担当者③"] == (None, "担当者③のウェイト", None)


def test_budget_and_history(report):
    budget = report.filter("`BLカテゴリ` = '予算'").orderBy("請求月").collect()
    assert [r["累計売上予算額"] for r in budget] == [1, 1, 4, 8, 13, 19, 7, 15, 24, 34, 45, 57]
    assert budget[0]["請求日（期）"] == "今期" and budget[6]["請求日（期）"] == "39.0期" and budget[0]["請求年"] == 2025
    history = report.filter("`年` IS NOT NULL")
    assert history.count() == 12 and history.select("税抜費用（int）", "課題ID", "税抜外注費用").distinct().collect() == [(11, 999999999, 0)]


def test_split_running_totals_agree(sources, report):
    small = revenue.RevenueConfig(range_rows=40, hot_rows=1)
    assert rows(revenue.final_output(sources, REF, small)) == rows(report)


def test_run_report_stores_and_counts(spark, sources, report, tmp_path):
    table, csv_out = str(tmp_path / "table"), str(tmp_path / "csv")
    assert revenue.read_report(spark, table) is None
    for _ in range(2):
        counts = revenue.run_report(sources, REF, table, csv_out)
    stored = revenue.read_report(spark, table)
    assert stored.columns == report.columns and rows(stored) == rows(report)
    assert counts["final_output"] == stored.count() == sum(
        counts[s] for s in ("cumulative_sales", "weight_rows", "budget", "history"))
    assert counts["task_list"] == 13
    assert spark.read.option("header", True).csv(csv_out).count() == counts["final_output"]
    tasks_only = stored.filter(F.col("BLカテゴリ") == "予算")
    assert "PartitionFilters: [isnotnull(BLカテゴリ" in tasks_only._jdf.queryExecution().toString()


def test_project_filter_reaches_every_branch(sources):
    plan = revenue.task_list(sources, dt.date(2025, 5, 10), revenue.RevenueConfig())._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("Union")[0]
    assert "Filter" not in top


def test_step_counts_cost_no_extra_job(spark):
    counts = StepCounts()
    counts.watch("all", spark.range(10)).filter("id > 5").collect()
    assert counts.result() == {"all": 10}


def test_cards_over_the_report(report):
    rows_ = [tuple(r) for r in cards.yoy(report, "2025-12-31", filters=cards.card_filters(cards.CardColumns())).collect()]
    assert [r[1] for r in rows_] == [f"{m}月" for m in range(1, 13)]
    assert rows_[0] == (1, "1月", 1050, 11, 95.4545) and rows_[1][2:] == (1000, 11, 90.9091)
    total = cards.yoy_totals(cards.yoy(report, "2025-12-31", filters=cards.card_filters(cards.CardColumns()))).first()
    assert total["current_year"] == 18956 and total["prev_year"] == 132 and total["yoy_ratio"] == round(18956 / 132, 4)
    only = cards.card_filters(cards.CardColumns(), category="予算", status="完了", code="x", project="P1")
    assert cards.yoy(report, "2025-12-31", filters=only).count() == 0
    wide, years = cards.revenue_by_year(report, filters=cards.card_filters(cards.CardColumns()))
    # The Excel task costs 50 and has no code, so the pivot leaves it out.
    assert years == [2025] and wide.count() == 6 and cards.year_totals(wide, years).first()["2025"] == 18956 - 50
    parts = cards.summary(report)
    assert [r[0] for r in parts["categories"].collect()] == ["ウェイト別課題", "課題リスト", "予算"]
    assert parts["budget"].count() == 12 and all(r["month"] is None for r in parts["monthly"].collect())
    page, total_rows = cards.explore(report, [asc("課題ID"), asc("担当者種別")], 1, 10, "ウェイト別課題", "月分")
    assert page.count() == 10 and total_rows.first()[0] == 45
    detail = {r["name"]: r for r in cards.dataset_detail(report).collect()}
    assert len(detail) == 55 and detail["BLカテゴリ"]["distinct_count"] == 3
    offered = {r["column"] for r in cards.card_filter_values(report).collect()}
    assert "種" in offered and "課題ID" not in offered


def test_generic_cards(report):
    tasks_only = {"BLカテゴリ": "課題リスト"}
    total = cards.build_card(report, cards.CardSpec(None, "税抜費用（int）", "SUM", filters=tasks_only)).first()[0]
    assert total == 18956 + 12 * 11
    pivot = cards.build_card(report, cards.CardSpec("請求年", "税抜費用（int）", "MAX", pivot="ステータス名", filters=tasks_only))
    assert "完了" in pivot.columns
    top = cards.build_card(report, cards.CardSpec("ERAWANコード", "*", "count", filters=tasks_only, limit=2))
    assert top.count() == 2
    bad = cards.CardSpec("無い列", "課題タイトル", "MEDIAN", filters={"also missing": 1})
    assert len(cards.validate_card(bad, report)) == 3
    assert cards.validate_card(cards.CardSpec("ERAWANコード", "課題タイトル", "SUM"), report) != []
    with pytest.raises(ValueError, match="無い列"):
        cards.build_card(report, bad)
