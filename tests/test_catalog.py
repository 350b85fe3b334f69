"""Formula catalog and card usage on small landed payloads."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerlens.functions.casts import squeeze_space, strip_space
from ledgerlens.functions.formulas import normalised, stripped, structural, with_fingerprints
from ledgerlens.plans import formulas as fx
from ledgerlens.plans import usage
from ledgerlens.queries import QUERIES
from ledgerlens.sources.files import read_json_lines
from ledgerlens.sources.payloads import payload_schema
from ledgerlens.sources.sinks import write_csv
from ledgerlens.sources.store import Store, refresh_tables


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")

    def land(name, records):
        path = root / f"{name}.json"
        path.write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in records), encoding="utf-8")
        return read_json_lines(spark, str(path), payload_schema(name))

    return land


def link(kind, ident, active=True):
    return {"active": active, "resource": {"type": kind, "id": ident}}


@pytest.fixture(scope="module")
def tables(landed):
    search = landed("formula_search", [
        {"id": 1, "name": "Sum", "owner": 7, "links": [link("CARD", "c1"), link("CARD", "c1"), link("CARD", "c2", False),
                                                     link("DATA_SOURCE", "d1"), link("DATA_SOURCE", "d2", False)]},
        {"id": 2, "name": "sum%", "owner": 8, "links": [link("CARD", "dr:55:x")]},
        {"id": 3, "name": "Lost", "owner": None}, {"id": 4, "name": "Sum", "links": []}, "{broken",
    ])
    detail = landed("formula_detail", [
        {"id": 1, "expression": "FORMULA_REF(3) + FORMULA_REF(3)", "legacyId": "L1"},
        {"id": 2, "expression": "sum( `X` )", "columnPositions": ["1"]},
        {"id": 4, "expression": " SUM( X )\n"},
    ])
    return {**fx.catalog_tables(search, detail)}


@pytest.fixture(scope="module")
def cards(spark):
    return spark.createDataFrame([("c1", 11), ("c2", 500), ("dr:55:x", None)], "id string, view_count bigint")


@pytest.fixture(scope="module")
def analysis(spark, tables, cards):
    owners = spark.createDataFrame([(7, "Ann")], "id bigint, name string")
    return fx.classify_usage(tables["formulas"], tables["card_map"], tables["dependency_map"], cards, owners,
                             url_base="u/").cache()


def test_landed_tables(tables):
    assert rows(tables["card_map"]) == [(1, "c1", True), (2, "dr:55:x", True)]
    assert rows(tables["dependency_map"]) == [(1, 3)]
    assert tables["formulas"].filter("id = 1").first()["datasources"] == '["d1","d2"]'
    assert rows(fx.missing_expressions(tables["formulas"])) == [(3,)]


def test_classification_is_a_partition(analysis):
    got = {r["bm_id"]: (r["group_number"], r["active_cards_count"], r["total_views"], r["referenced_by_count"], r["owner_name"],
                        r["dataset_names"], r["url"], r["naming_flag"]) for r in analysis.collect()}
    assert got == {1: (4, 1, 11, 0, "Ann", "d1, d2", "u/1", ""), 2: (3, 1, 0, 0, "", "", "u/2", ""),
                   3: (4, 0, 0, 1, "", "", "u/3", ""), 4: (1, 0, 0, 0, "", "", "u/4", "")}
    assert sum(r["count"] for r in fx.group_counts(analysis).collect()) == 4
    # Without cards there are no views, so "once used" stays empty.
    assert analysis.filter("group_number = 2").count() == 0


def test_duplicates(analysis, tables):
    assert fx.duplicate_members(analysis, "duplicate_hash").count() == 0
    normal = fx.duplicate_members(analysis, "normalized_hash").collect()
    assert sorted((r["cnt"], r["bm_id"]) for r in normal) == [(2, 2), (2, 4)]
    assert sorted(r["bm_id"] for r in fx.duplicate_members(analysis, "structure_hash").collect()) == [2, 4]
    names = fx.duplicate_names(analysis, tables["formulas"]).collect()
    assert sorted((r["bm_name"], r["bm_id"]) for r in names) == [("Sum", 1), ("Sum", 4)]


def test_hot_duplicate_group_is_kept_whole(spark):
    df = spark.range(6000).select(F.col("id").alias("bm_id"), F.when(F.col("id") < 4000, "hot").otherwise(F.col("id").cast("string")).alias("h"))
    members = fx.duplicate_members(df, "h").collect()
    assert sorted(r["bm_id"] for r in members) == list(range(4000)) and {r["cnt"] for r in members} == {4000}


def test_search_and_listing(analysis, tables):
    ids = lambda df: [r["bm_id"] for r in df.collect()]
    f = tables["formulas"]
    assert ids(fx.search_formulas(analysis, f, " SUM ")) == [1, 2, 4]
    assert ids(fx.search_formulas(analysis, f, "%")) == [2] and ids(fx.search_formulas(analysis, f, " ")) == []
    assert ids(fx.search_formulas(analysis, f, "3")) == [3]
    assert ids(fx.group_listing(analysis, f, 4)) == [1, 3] and ids(fx.group_listing(analysis, f, 4, 1, 1)) == [3]
    assert ids(fx.with_card(analysis, tables["card_map"], "5")) == [2]


def test_ranking_and_summary(analysis, tables):
    ranking = fx.dataset_cleanup_ranking(analysis, "d/").collect()
    assert [tuple(r) for r in ranking] == [("d1", "d/d1", 1, 0, 0)]
    assert fx.catalog_summary(analysis, tables["formulas"])["duplicates_normalized"].count() == 1


def test_export(spark, analysis, tables, tmp_path):
    out = fx.export_catalog(analysis, tables["formulas"], tables["card_map"], "ja", card_url_base="k/")
    assert [r["グループラベル"] for r in out.collect()] == ["未使用", "低閲覧", "稼働中", "稼働中"]
    assert {r["リンクカード"] for r in out.collect()} == {"", "k/c1", "k/55"}
    write_csv(out.coalesce(1), str(tmp_path / "x"), bom=True)
    text = next((tmp_path / "x").glob("*.csv")).read_bytes()
    assert text.startswith("﻿".encode()) and "BM ID" in text.decode("utf-8-sig").splitlines()[0]
    assert fx.export_catalog(analysis, tables["formulas"], tables["card_map"], "vi", group=1).count() == 1


def test_refresh_replaces_edges_too(spark, tables, tmp_path):
    refresh_tables({"dependency_map": spark.createDataFrame([(9, 9)], "bm_id bigint, depends_on_bm_id bigint")}, str(tmp_path))
    refresh_tables(tables, str(tmp_path))
    store = Store(spark, str(tmp_path))
    assert rows(store.read("dependency_map")) == [(1, 3)]
    assert store.read("formulas").count() == 4


def test_prune_formula(landed):
    ref = lambda *ids: [{"formulaId": i, "column": "c"} for i in ids]
    defs = landed("card_definition", [
        {"urn": "1", "formulas": [{"id": "x"}, {"id": "y"}, {"name": "no id"}],
         "subscriptions": {"big": {"columns": ref("x", None, "y"), "orderBy": ref("x")}, "main": {"groupBy": ref("y", "x")}}},
        {"urn": "2", "formulas": [{"id": "y"}]}])
    got = {r["urn"]: r for r in fx.prune_formula(defs, "x").collect()}
    assert got["1"]["removed_count"] == 1 and [f["id"] for f in got["1"]["formulas"]] == ["y", None]
    subs = got["1"]["subscriptions"]
    assert [r["formulaId"] for r in subs["big"]["columns"]] == [None, "y"] and subs["big"]["orderBy"] == []
    assert [r["formulaId"] for r in subs["main"]["groupBy"]] == ["y"] and subs["main"]["columns"] is None
    assert got["2"]["removed_count"] == 0
    main = fx.prune_formula(defs, "x").select(fx.main_subscription(F.col("subscriptions")).alias("m")).collect()
    assert main[0]["m"]["groupBy"][0]["formulaId"] == "y" and main[1]["m"] is None


# ---- cards and dashboards ----

@pytest.fixture(scope="module")
def card_table(landed):
    page = lambda i, t: [{"pageId": i, "title": t}, {"pageId": 99, "title": "parent"}]
    summary = landed("card_summary", [
        {"id": "a", "title": "Sales", "type": "kpi", "pageHierarchy": page(1, "Home"), "owners": [{"displayName": "Ann"}]},
        {"id": "b", "title": "Costs 100%", "type": "kpi", "pageHierarchy": page(1, "Home"), "owners": []},
        {"id": "c", "type": "doc", "pageHierarchy": []}, {"id": "d", "title": "Old"}])
    info = landed("card_info", [
        {"id": "a", "viewInfo": {"totalViewCount": 50, "lastViewedDate": 1600000000000},
         "datasources": [{"dataSourceId": "s1", "dataSourceName": "S"}, {"dataSourceId": "s2"}]},
        {"id": "b", "viewInfo": {"totalViewCount": 3, "lastViewedDate": 0}, "datasources": [{"dataSourceId": "s1", "dataSourceName": "S"}]},
        {"id": "c"}, {"id": "zz", "viewInfo": {"totalViewCount": 1}}])
    return usage.refresh_view_counts(usage.card_table(summary), info).cache()


def test_view_refresh(card_table):
    got = {r["id"]: (r["view_count"], str(r["last_viewed_at"]), r["datasource_id"], r["owner_name"], r["page_title"]) for r in card_table.collect()}
    assert got == {"a": (50, "2020-09-13 12:26:40", "s1", "Ann", "Home"), "b": (3, "None", "s1", "", "Home"),
                   "c": (0, "None", None, "", ""), "d": (0, "None", None, "", "")}


def test_card_pages(card_table):
    page, total = usage.card_list(card_table, text="0%", number=1, size=5)
    assert [r["id"] for r in page.collect()] == ["b"] and total.first()[0] == 1
    ids = [usage.card_list(card_table, number=n, size=3)[0].collect() for n in (1, 2)]
    assert [[r["id"] for r in p] for p in ids] == [["a", "b", "c"], ["d"]]
    assert rows(usage.card_types(card_table)) == [("doc",), ("kpi",)]
    grid, pages = usage.dashboards(card_table)
    assert [tuple(r) for r in grid.collect()] == [(1, "Home", 2, 53)] and pages.first()[0] == 1


def test_stats_and_low_usage(card_table):
    assert tuple(usage.global_stats(card_table).first()) == (4, 1, 53, 3, 2)
    assert [tuple(r) for r in usage.type_distribution(card_table).collect()] == [("kpi", 2, 53), ("doc", 1, 0)]
    assert [tuple(r) for r in usage.top_dashboards(card_table).collect()] == [("Home", 2, 53)]
    low = usage.low_usage_cards(card_table, 10)
    assert [r["id"] for r in usage.low_usage_page(low)[0].collect()] == ["c", "d", "b"]
    assert rows(usage.low_usage_by_owner(low)) == [("", 3, 3, 2)]
    assert (1, "Home", 1, 3, 0) in rows(usage.low_usage_by_dashboard(low))
    assert ("kpi", 1, 3) in rows(usage.low_usage_by_type(low))
    by_dataset = usage.low_usage_by_dataset(card_table).first()
    assert tuple(by_dataset)[:4] == ("s1", "S", 2, 1) and float(by_dataset["low_usage_pct"]) == 50.0
    assert usage.low_usage_cards(card_table, 10, card_type="KPI ").count() == 1


def test_texts_are_digested_once_and_only_where_digests_are_asked_for(spark):
    digests = lambda q: QUERIES[q](
        spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("md5(")
    assert digests("q_export_labels") == digests("q_fingerprints") == 3
    for q in ("q_group_counts", "q_cleanup_ranking", "q_search", "q_with_card"):
        assert digests(q) == 0, q


def test_links_in_several_rows_count_once(spark, tables, cards):
    several = tables["card_map"].unionByName(tables["card_map"]).unionByName(
        spark.createDataFrame([(1, "c1", False), (4, "c1", False), (4, "c1", None)], "bm_id bigint, card_id string, is_active boolean"))
    once = fx.classify_usage(tables["formulas"], tables["card_map"], tables["dependency_map"], cards)
    assert rows(fx.classify_usage(tables["formulas"], several, tables["dependency_map"], cards)) == rows(once)
    assert rows(fx.card_lists(several)) == [(1, "c1"), (2, "55")]
    plan = QUERIES["q_group_listing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "bool_or" not in plan and "l_quantity#" in plan  # lines are filtered before they are grouped


def test_forms_of_texts_are_those_of_a_plain_search(spark):
    parts = ["", " ", "\n\t", "a", "A  b", "/* x\n 'q' */", "/*", "-- rest", "-", "'s t'", "'", '"N 1"', '"', "`", "12.5", "x7", "٣",
             "FORMULA_REF(12)", "formula_ref(", "\u3000", "\u00a0z", "𝒳 "]
    texts = [a + b + c for a in parts for b in parts for c in parts]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    normal = squeeze_space(F.replace(F.lower(F.regexp_replace(F.regexp_replace(
        "t", r"(?s)/\*.*?\*/", ""), r"--[^\n]*", "")), F.lit("`"), F.lit("")))
    plain = normal
    for pattern, mark in ((r"(?U)formula_ref\(\d+\)", "BM_REF"), (r"'[^']*'", "STR"), (r'"[^"]*"', "COL"),
                          (r"(?U)(?=\d)\b\d+(\.\d+)?\b", "NUM")):
        plain = F.regexp_replace(plain, pattern, mark)
    got = df.select(
        stripped(F.col("t")).eqNullSafe(strip_space(F.col("t"))).alias("a"), normalised(F.col("t")).eqNullSafe(normal).alias("b"),
        structural(normalised(F.col("t"))).eqNullSafe(squeeze_space(plain)).alias("c"))
    assert got.filter("NOT (a AND b AND c)").count() == 0
    plan = with_fingerprints(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{2,}") == 1 and plan.count("ontains(") >= 5  # squeezed once, searched where there is a mark
