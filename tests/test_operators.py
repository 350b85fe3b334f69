"""Reshaping, merging and aggregate operators on small hand-checked rows."""

import datetime as dt
import csv
import json
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerlens.operators import aggregates, merging, reshape


def test_unpivot_pairs_keeps_null_and_reads_once(spark, tmp_path):
    spark.createDataFrame([(1, "x", 10, None, None), (2, None, None, "y", 5)],
                          "id int, a string, aw int, b string, bw int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = reshape.unpivot_pairs(df, [("a", "aw"), ("b", "bw")], "slot", "who", "weight_slot", "weight")
    assert rows(out) == sorted([
        (1, "a", "x", "aw", 10), (1, "b", None, "bw", None),
        (2, "a", None, "aw", None), (2, "b", "y", "bw", 5)], key=repr)
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1


def test_unpivot_numbered_keeps_null(spark):
    df = spark.createDataFrame([("2024", 5, None)], "y string, `1月` int, `2月` int")
    assert rows(reshape.unpivot_numbered(df, ["1月", "2月"], "m", "v")) == [("2024", 1, 5), ("2024", 2, None)]


def test_month_expansion(spark):
    day = lambda m: dt.date(2024, m, 1)
    spans = spark.createDataFrame([
        ("inside", day(2), day(4)), ("single", day(3), day(3)), ("reversed", day(5), day(2)),
        ("early", dt.date(2020, 1, 1), day(1)), ("late", day(6), dt.date(2030, 1, 1)),
        ("outside", dt.date(2019, 1, 1), dt.date(2019, 5, 1)), ("nostart", None, day(4)),
        ("noend", day(1), None)], "k string, s date, e date")
    calendar = spark.createDataFrame([(day(m),) for m in (1, 2, 3, 4, 6)] + [(day(3),), (None,)], "d date")
    args = (spans, F.col("s"), F.col("e"), calendar, "d")
    got = rows(reshape.expand_months(*args).select("k", "d"))
    assert got == sorted([("inside", day(2)), ("inside", day(3)), ("inside", day(3)), ("inside", day(4)),
                          ("single", day(3)), ("single", day(3)), ("early", day(1)), ("late", day(6))], key=repr)
    empty = calendar.filter("d > '2050-01-01'")
    assert reshape.expand_months(spans, F.col("s"), F.col("e"), empty, "d").count() == 0


def test_pivot_cells_sum_to_the_base(spark):
    df = spark.createDataFrame([(1, 2024, 5), (1, 2025, 7), (2, 2025, 1), (2, 2025, None)], "m int, y int, v int")
    wide, years = reshape.pivot_sum(df, ["m"], "y", "v")
    assert years == [2024, 2025] and rows(wide) == [(1, 5, 7), (2, 0, 1)]


def test_links_and_edges(spark):
    schema = "id int, links array<struct<active: boolean, resource: struct<type: string, id: string>>>"
    df = spark.createDataFrame([(1, [(True, ("CARD", "c1")), (False, ("CARD", "c2")), (None, ("DATA_SOURCE", "d"))]),
                                (2, None)], schema)
    assert rows(reshape.exploded_links(df, ["id"], "links", "CARD")) == [(1, "c1")]
    assert [r[0] for r in df.orderBy("id").select(reshape.link_ids(F.col("links"), "DATA_SOURCE")).collect()] == [["d"], None]


def test_best_per_key_uses_no_window(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], "k string, t int, v string")
    last = merging.best_per_key(df, ["k"], [F.col("t")])
    assert rows(last) == [("a", 3, "y"), ("b", 2, None)]
    assert "Window" not in last._jdf.queryExecution().executedPlan().toString()
    assert rows(merging.best_per_key(df, ["k"], [F.col("t")], latest=False)) == [("a", 1, "x"), ("b", 2, None)]


def test_upsert_changes_only_given_columns(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, name string, n int")
    updates = spark.createDataFrame([(2, "old", 1), (2, None, 2), (3, "new", 1)], "id int, name string, seq int")
    got = rows(merging.upsert(target, updates, ["id"], "seq"))
    assert got == [(1, "a", 10), (2, None, 20), (3, "new", None)]
    again = merging.upsert(merging.upsert(target, updates, ["id"], "seq"), updates, ["id"], "seq")
    assert rows(again) == got


def test_overlay(spark):
    base = spark.createDataFrame([("1", "a", 5), ("2", "b", 6), ("3", "c", 7)], "id string, name string, n int")
    detail = spark.createDataFrame([("1", "", 0, "x"), ("2", "B", None, "y")], "id string, name string, n int, more string")
    assert rows(merging.overlay(base, detail, ["id"])) == [("1", "a", 0, "x"), ("2", "B", 6, "y"), ("3", "c", 7, None)]


def test_update_without_insert(spark):
    target = spark.createDataFrame([(1, "a")], "id int, name string")
    updates = spark.createDataFrame([(1, "b"), (2, "c")], "id int, name string")
    assert rows(merging.upsert(target, updates, ["id"], insert=False)) == [(1, "b")]


def test_lookup_with_hot_and_missing_keys(spark):
    left = spark.range(900).select(
        "id", F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, F.col("id")).alias("k"))
    right = spark.createDataFrame([(5, "five"), (1, "one"), (4, None)], "key bigint, name string")
    plain = rows(left.join(right, left.k == right.key, "left").select("id", "k", "name"))
    for hot_rows in (10**9, 100):
        assert rows(merging.lookup(left, right, "k", "key", hot_rows)) == plain


def test_lookup_spreads_hot_and_missing_keys(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = spark.range(8000).select(F.when(F.col("id") % 2 == 0, 5).alias("k"), "id")
        right = spark.range(100).select(F.col("id").alias("key"), F.lit("x").alias("name"))
        out = merging.lookup(left, right, "k", "key", hot_rows=100)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(.*__part#", plan)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert out.count() == 8000 and max(sizes) < 3000
        # Far more hot keys than any list of them could name.
        many = spark.range(20_000).select((F.col("id") % 4000).alias("k"), "id")
        names = spark.range(4000).select(F.col("id").alias("key"), F.col("id").cast("string").alias("name"))
        found = merging.lookup(many, names, "k", "key", hot_rows=2)
        assert found.filter("name = cast(k as string)").count() == found.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_profile_counts_all_kinds_of_values(spark):
    df = spark.createDataFrame(
        [(0.0, b"\xff", [1], "a"), (-0.0, b"\xfe", [1], None), (float("nan"), None, [2], ""), (None, b"\xff", None, "a")],
        "x double, b binary, l array<int>, s string")
    got = aggregates.column_profile(df, samples=1)
    assert rows(got.select("name", "total_rows", "null_count", "distinct_count")) == [
        ("b", 4, 1, 2), ("l", 4, 1, 2), ("s", 4, 1, 2), ("x", 4, 1, 2)]
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    none = aggregates.column_profile(df.limit(0))
    assert [tuple(r)[2:] for r in none.collect()] == [(0, 0, 0, [])] * 4


def test_digests_are_made_once(spark):
    from ledgerlens.functions.formulas import with_fingerprints

    df = spark.createDataFrame([(1, "SUM(`a`) -- x"), (2, "sum(a)"), (3, "")], "id int, e string")
    made = with_fingerprints(df, "e").filter("structure_hash <> ''")
    both = made.join(made.groupBy("structure_hash").count(), "structure_hash").select("id", "count")
    assert rows(both) == [(1, 2), (2, 2)]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("md5(") == 3 and plan.count("regexp_replace(") <= 12


def test_pivot_refuses_too_many_headers(spark):
    with pytest.raises(ValueError, match="1000"):
        reshape.few_values(spark.range(2000), "id")


def test_filter_values_counts_once(spark, tmp_path):
    spark.createDataFrame([("a", "b")], "x string, y string").write.parquet(str(tmp_path / "v"))
    out = aggregates.filter_values(spark.read.parquet(str(tmp_path / "v")), ["x", "y"])
    assert rows(out) == [("x", "a", 1), ("y", "b", 1)]
    assert "ReusedExchange" in str(out._jdf.queryExecution().executedPlan().toString())


def test_first_wins(spark):
    a = spark.createDataFrame([(1, "type")], "id int, by string")
    b = spark.createDataFrame([(1, "cards"), (2, "cards")], "id int, by string")
    assert rows(merging.first_wins([a, b], ["id"])) == [(1, "type"), (2, "cards")]


def test_aggregates(spark):
    df = spark.createDataFrame([("x", 1), ("x", None), ("", 2), (None, 2)], "k string, v int")
    assert [tuple(r) for r in aggregates.count_by(df, "k", k=2).collect()] == [("x", 2), ("", 1)]
    assert rows(aggregates.state_counts(df, F.col("k"))) == [("UNKNOWN", 2), ("x", 2)]
    assert rows(aggregates.distinct_values(df, "k")) == [("x",)]
    assert rows(aggregates.child_counts(df, "k", "v", "n")) == [("", 1), ("x", 1)]
    profile = {r["name"]: r for r in aggregates.column_profile(df, 2, [F.asc_nulls_last("k")]).collect()}
    assert profile["k"][1:5] == ("string", 4, 1, 2) and profile["v"]["samples"] == ["2", "1"] or profile["v"]["samples"] == ["2", None]


def test_filter_values_cut_off_counts_blank_but_not_null(spark):
    df = spark.createDataFrame([("a", "p"), ("b", "p"), ("", None), (None, "q")], "three string, two string")
    got = aggregates.filter_values(df, ["three", "two", "absent"], max_distinct=2)
    assert rows(got) == [("two", "p", 2), ("two", "q", 1)]
    assert rows(aggregates.filter_values(df, ["three"], 3)) == [("three", "a", 1), ("three", "b", 1)]


def test_the_last_to_arrive_wins(spark):
    target = spark.createDataFrame([(1, "a")], "id int, v string")
    updates = spark.createDataFrame(
        [(1, "z", 1), (1, "c", 3), (1, "y", 2), (2, "d", 1), (2, "d", 1)], f"id int, v string, {merging.ARRIVAL} int")
    assert rows(merging.upsert(target, updates, ["id"])) == [(1, "c"), (2, "d")]
    assert rows(merging.overlay(target, updates, ["id"])) == [(1, "c")]


def test_repeated_updates_without_an_order_are_an_error(spark):
    target = spark.createDataFrame([(1, "a")], "id int, v string")
    updates = spark.createDataFrame([(1, "b"), (1, "c"), (2, "d")], "id int, v string")
    with pytest.raises(Exception, match="no sequence to tell the last"):
        merging.upsert(target, updates, ["id"]).collect()
    assert rows(merging.upsert(target, updates.filter("v <> 'b'"), ["id"])) == [(1, "c"), (2, "d")]


def test_arrival_follows_files_and_lines(spark, tmp_path):
    from ledgerlens.sources.files import read_json_lines

    for name, first in (("b", 0), ("a", 50_000)):
        (tmp_path / f"{name}.json").write_text("".join(
            json.dumps({"id": i % 7, "n": first + i}) + "\n" for i in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        landed = read_json_lines(spark, str(tmp_path), "id int, n int", arrival=True)
        assert landed.rdd.getNumPartitions() > 4
        got = rows(merging.last_writes(landed, ["id"]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((i % 7, i) for i in range(49_993, 50_000))  # of the file that comes last


def test_broken_csv_rows_stay_away_from_every_selection(spark, tmp_path):
    from ledgerlens.sources.files import read_csv, read_csv_named, text_schema

    (tmp_path / "x.csv").write_text("id,name\n1,a\n2\n3,c,more\n4,d\n")
    df = read_csv(spark, str(tmp_path / "x.csv"), text_schema(["id", "name"]))
    assert rows(df) == [("1", "a"), ("4", "d")]
    assert rows(df.select("id")) == [("1",), ("4",)] and df.count() == 2
    named = read_csv_named(spark, str(tmp_path / "x.csv"), ["name"])
    assert rows(named) == [("a",), ("d",)]


@pytest.mark.parametrize("split", ["700", "100000000"])
def test_quoted_breaks_are_read_in_splits(spark, tmp_path, split):
    from ledgerlens.sources.files import read_csv, text_schema

    rng = random.Random(4)
    cell = lambda: "".join(rng.choice("ab ,\"\n\né'") for _ in range(rng.choice([0, 1, 3, 9, 60]))).strip(" ")
    data = [[str(i), cell(), cell()] for i in range(400)]
    data[7][1] = "x\n" * 900  # over several splits
    for name, end, header in (("a", "\n", "first"), ("b", "\r\n", "fi\nrst")):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerows([["id", header, "second"], *data[name == "b"::2]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_csv(spark, str(tmp_path), text_schema(["id", "first", "second"]))
        assert (spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20) == (split == "700")
        assert rows(df) == sorted((tuple(c or None for c in r) for r in data), key=repr)
        assert df.limit(0).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pivot_keeps_rows_without_a_header(spark):
    from ledgerlens.plans.cards import CardSpec, build_card, card_cells

    df = spark.createDataFrame([("a", "x", 1), ("a", None, 5), ("b", None, 7)], "r string, p string, v int")
    card = build_card(df, CardSpec(row="r", value="v", pivot="p"))
    assert card.columns == ["r", "x", "null"]
    assert [tuple(r) for r in card.collect()] == [("b", None, 7), ("a", 1, 5)]
    text = df.unionByName(df.withColumns({"p": F.lit("null"), "v": F.col("v") * 100}))
    card = build_card(text, CardSpec(row="r", value="v", pivot="p", sort="ASC"))
    assert card.columns == ["r", "null", "x", "(null)"]
    assert [tuple(r) for r in card.collect()] == [("a", 600, 1, 5), ("b", 700, None, 7)]
    cells = card_cells(text, CardSpec(row="r", value="v", pivot="p", filters={"v": ("between", (1, 100))}))
    assert rows(cells) == sorted([
        ("cell", "a", "x", 1), ("cell", "a", "null", 100), ("cell", "a", None, 5), ("cell", "b", None, 7),
        ("row", "a", None, 106), ("row", "b", None, 7), ("header", None, "x", 1), ("header", None, "null", 100),
        ("header", None, None, 12), ("all", None, None, 113)], key=repr)
    with pytest.raises(ValueError, match="unknown comparison"):
        build_card(df, CardSpec(row="r", value="v", filters={"v": ("like", 1)}))


def test_casts_follow_the_whole_text(spark):
    from ledgerlens.functions import casts
    from ledgerlens.plans.revenue import route_cost

    texts = ["2024-01-01 abc", "2024-01-01 10:20", "１２", "1_000", "0x10", "0b11", "123\n", "1_0.5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        casts.try_date(F.col("t")).cast("string"), casts.try_bigint(F.col("t")), route_cost(F.col("t")))
    assert [tuple(r) for r in df.collect()] == [
        (None, None, None), ("2024-01-01", None, None), (None, None, None), (None, 1000, None),
        (None, 16, None), (None, 3, None), (None, 123, None), (None, 11, None)]
