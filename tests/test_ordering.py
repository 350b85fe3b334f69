"""Range-wise row numbers and running sums against brute force, hot groups and full ties included."""

import random

import pytest
from conftest import rows
from pyspark import TaskContext
from pyspark.sql import functions as F

from ledgerlens.operators import ordering
from ledgerlens.operators.ordering import asc, desc


def brute_running(data, key, order, value):
    out = []
    for k in {key(r) for r in data}:
        total = None
        for r in sorted((r for r in data if key(r) == k), key=order):
            v = value(r)
            total = total if v is None else (total or 0) + v
            out.append((*r, total))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.5 else rng.choice([None, "a", "b", "c"])
        amount = None if rng.random() < 0.2 else rng.randint(-50, 50)
        data.append((i, key, rng.randint(1, 5), amount))
    return data, spark.createDataFrame(data, "id int, k string, day int, v bigint").repartition(7)


def by_day_and_id():
    return [asc("day"), asc("id")]


@pytest.mark.parametrize("range_rows", [10**9, 500, 7])
def test_running_sums(skewed, range_rows):
    data, df = skewed
    got = ordering.running_sums(df, {"total": F.col("v")}, ["k"], by_day_and_id(), range_rows)
    assert rows(got) == brute_running(data, lambda r: r[1], lambda r: r[2:3] + r[:1], lambda r: r[3])


@pytest.mark.parametrize("ranges", [1, 6, 40])
def test_ranges_follow_the_rows(skewed, ranges):
    data, df = skewed
    hot = df.filter("k = 'hot'")
    n = hot.count()
    found = ordering.ranges_of(hot, [asc("k"), *by_day_and_id()], -(-n // ranges))
    sizes = dict(found.assign(hot).groupBy("__range").count().collect())
    assert sorted(sizes) == list(range(ranges))
    assert max(sizes.values()) < 2.5 * n / ranges


def test_ranges_keep_every_order(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([None, 1.5, -2.0, float("nan"), 7.0]), rng.choice([None, "a", "b", "B", ""]))
            for i in range(400)]
    df = spark.createDataFrame(data, "id int, x double, s string").repartition(5)
    for order in ([asc("x"), desc("s"), asc("id")], [desc("x", nulls_last=False), asc("s", True), desc("id")],
                  [asc("s"), desc("x"), asc("id")]):
        placed = ordering.ranges_of(df, order, 23).assign(df)
        found = [r["__range"] for r in placed.orderBy(*ordering.sorts(order)).collect()]
        assert found == sorted(found) and len(set(found)) > 10


def test_bounds_of_every_type_keep_their_values(spark):
    df = spark.range(300).select(
        F.timestamp_micros(F.col("id") * 7 + 10 ** 15).alias("ts"), F.expr("date_add(DATE'0999-12-25', cast(id as int))").alias("d"),
        (F.col("id") / F.lit(7.0)).alias("x"), F.expr("cast(id as decimal(30,10)) / 3").alias("dec"),
        F.expr("if(id % 9 = 0, float('nan'), cast(id / 3 as float))").alias("f"),
        F.expr("timestamp_micros(id * 7)").cast("timestamp_ntz").alias("ntz"), F.expr("id % 2 = 0").alias("flag"),
        F.concat(F.lit("\"é\\\n"), "id").alias("s"), F.encode(F.col("id").cast("string"), "UTF-8").alias("bin"))
    for c in df.columns:
        found = ordering.Ranges(df, [asc(c)], 300, 30)
        bounds = spark.range(1).select(F.inline(found.literal()))
        assert bounds.join(df, bounds["k0"].eqNullSafe(df[c]), "left_anti").count() == 0
        placed = [r["__range"] for r in found.assign(df).orderBy(c).collect()]
        assert placed == sorted(placed) and (len(set(placed)) == 30 or c in ("flag", "f"))


def test_rows_equal_in_the_order_are_dealt(spark):
    df = spark.range(600).select(F.lit("x").alias("k"), F.lit(1).alias("day"), F.col("id").alias("v"))
    got = ordering.running_sums(df, {"t": F.col("v") * 0 + 2}, ["k"], [asc("day")], 50)
    assert [r["t"] for r in got.orderBy("t").collect()] == list(range(2, 1201, 2))
    same = df.withColumn("v", F.lit(2))
    got = ordering.running_sums(same, {"t": F.col("v")}, ["k"], [asc("day")], 50)
    assert [r["t"] for r in got.orderBy("t").collect()] == list(range(2, 1201, 2))


def test_one_exchange_of_the_rows(skewed):
    _, df = skewed
    got = ordering.running_sums(df, {"total": F.col("v")}, ["k"], by_day_and_id(), 500)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1 and "Repartition" not in plan.split("Join")[0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan


def test_two_keys_with_null(spark):
    data = [(1, "p", None, 10), (2, "p", None, 5), (3, None, "c", 1), (4, None, "c", None), (5, "p", "c", 7)]
    df = spark.createDataFrame(data, "id int, a string, b string, v bigint")
    for range_rows in (1, 2, 100):
        got = ordering.running_sums(df, {"t": F.col("v")}, ["a", "b"], [asc("id")], range_rows)
        assert {r["id"]: r["t"] for r in got.collect()} == {1: 10, 2: 15, 3: 1, 4: 1, 5: 7}
    empty = ordering.running_sums(df.limit(0), {"t": F.col("v")}, ["a", "b"], [asc("id")])
    assert empty.count() == 0


def test_row_numbers(skewed):
    data, df = skewed
    got = ordering.global_row_number(df, by_day_and_id(), "n", range_rows=500)
    ids = [r["id"] for r in got.orderBy("n").collect()]
    assert ids == [r[0] for r in sorted(data, key=lambda r: (r[2], r[0]))]
    assert sorted(r["n"] for r in got.collect()) == list(range(1, len(data) + 1))


def test_row_numbers_restart(skewed):
    data, df = skewed
    got = ordering.global_row_number(df, by_day_and_id(), "n", restart="day", range_rows=500)
    for day in range(1, 6):
        mine = got.filter(F.col("day") == day).orderBy("n").collect()
        assert [r["n"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["id"] for r in mine] == sorted(r[0] for r in data if r[2] == day)


def test_row_numbers_need_no_single_partition(skewed):
    _, df = skewed
    plan = ordering.global_row_number(df, by_day_and_id(), "n", range_rows=500)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


@pytest.mark.parametrize("top_rows,page_ranges", [(10**6, 1000), (0, 1000), (0, 3), (400, 5)])
def test_pages_cover_everything_once(skewed, top_rows, page_ranges):
    data, df = skewed
    small = df.filter("id < 95")
    seen = []
    for number in range(1, ordering.total_pages(95, 20) + 1):
        part = ordering.window_of_rows(
            small, [asc("day"), desc("id")], (number - 1) * 20, 20, top_rows, page_ranges)
        seen += [r["id"] for r in part.collect()]
    assert seen == [r[0] for r in sorted(data[:95], key=lambda r: (r[2], -r[0]))]
    beyond = ordering.window_of_rows(small, by_day_and_id(), 200, 20, top_rows, page_ranges)
    assert beyond.count() == 0
    same = small.select(F.lit(1).alias("day"), F.lit(2).alias("id"))
    assert ordering.window_of_rows(same, by_day_and_id(), 90, 20, top_rows, page_ranges).count() == 5
    assert ordering.total_pages(0, 20) == 0 and ordering.total_pages(95, 20) == 5


def test_sort_columns_puts_nulls_last_both_ways(skewed):
    _, df = skewed
    for direction in ("asc", "DESC"):
        order = ordering.sort_columns("v", direction, ["v"], "id", ["id"])
        values = [r["v"] for r in df.orderBy(*ordering.sorts(order)).collect()]
        first_null = values.index(None)
        assert all(v is None for v in values[first_null:])
    order = ordering.sort_columns("unknown", "ASC", ["v"], "id", ["id"])
    assert df.orderBy(*ordering.sorts(order)).first()["id"] == 0


def test_bounds_are_sampled_where_the_rows_lie(spark):
    task = F.udf(lambda _: TaskContext.get().partitionId(), "int")
    df = spark.range(0, 8000, numPartitions=8)
    found = ordering.Ranges(df, [asc(task("id"))], 8000, 8).bounds
    assert len(found) > 1


def test_wide_rows_make_more_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_BYTES", 80_000)
    narrow = spark.range(1000)
    wide = narrow.select("id", *[F.lit("x").alias(f"c{i}") for i in range(20)])
    bounds = lambda df: len(ordering.ranges_of(df, [asc("id")], 10**6).bounds)
    assert bounds(narrow) == 0
    assert bounds(wide) == 7
