"""Tables that change together, and keyed tables of which only touched buckets are written."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerlens.operators.merging import ARRIVAL
from ledgerlens.sources.store import Store


def people(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("p"), "id").alias("name"))


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.publish({"people": people(spark, 500)}, {"people": ["id"]}, buckets=16)
    before = store.files("people")
    assert len(before) == 16
    updates = spark.createDataFrame(
        [(3, "z", 1), (3, "new", 2), (900, "added", 1)], f"id long, name string, {ARRIVAL} int")
    store.upsert("people", updates)
    after = store.files("people")
    changed = {b for b in after if before.get(b) != after[b]}
    assert 1 <= len(changed) <= 2 and len(after) == 16
    want = {i: f"p{i}" for i in range(500)} | {3: "new", 900: "added"}
    assert dict(rows(store.read("people"))) == want
    assert dict(rows(store.read("people", 1)))[3] == "p3"
    store.upsert("people", updates.withColumn("id", F.col("id") + 10_000), insert=False)
    assert dict(rows(store.read("people"))) == want


def test_a_failed_run_leaves_the_old_pair(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("a") is None
    store.publish({"a": people(spark, 3), "b": people(spark, 4)})
    broken = people(spark, 9).withColumn("name", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.publish({"a": people(spark, 8), "b": broken})
    assert store.read("a").count() == 3 and store.read("b").count() == 4
    # A plan may read what it replaces, and other tables stay.
    store.publish({"a": store.read("a").unionByName(people(spark, 2))})
    assert store.read("a").count() == 5 and store.read("b").count() == 4


def test_the_second_of_two_writers_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.publish({"a": people(spark, 3)})
    other = Store(spark, str(tmp_path))
    other._numbers = lambda: []  # looked before the first had committed
    with pytest.raises(RuntimeError, match="another run"):
        other._commit({"a": {}})
    assert store.read("a").count() == 3


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.publish({"a": people(spark, 100), "b": people(spark, 4)}, {"a": ["id"]}, buckets=4)
    for n in range(3):
        store.upsert("a", spark.createDataFrame([(n, "x")], "id long, name string"))
    store.vacuum(1)
    assert store.read("a").filter("name = 'x'").count() == 3
    assert store.read("a").count() == 100 and store.read("b").count() == 4
    assert sum(1 for _ in (tmp_path / "a").iterdir()) <= 4


def test_partitions_types_and_empty_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "05", None), (2, None, 2.5)], "id int, kind string, x double")
    store.publish({"t": df, "none": df.limit(0)}, {"none": ["id"]}, partition_by={"t": ["kind"]})
    assert rows(store.read("t")) == rows(df) and store.read("t").schema.names == ["id", "kind", "x"] 
    assert store.read("none").count() == 0 and store.read("none").schema == df.schema
    store.upsert("none", df)
    assert rows(store.read("none")) == rows(df)
