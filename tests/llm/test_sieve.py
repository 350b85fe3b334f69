"""The bitmap of keys: no key of the list is missed, few others pass, and texts stay where they are."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.sieve import with_maybe


@pytest.mark.parametrize("max_bits,most", [(1 << 27, 1500), (1 << 15, 10_000)])
def test_keys_of_the_list_always_pass(spark, max_bits, most):
    df = spark.range(20_000).select("id", F.xxhash64("id").alias("key"))
    keys = df.filter("id % 2 = 0").select("key")
    got = {(r["id"], r["maybe"]) for r in with_maybe(df, "key", keys, "maybe", max_bits).select("id", "maybe").collect()}
    assert len(got) == 20_000
    assert all((i, True) in got for i in range(0, 20_000, 2))
    assert sum((i, True) in got for i in range(1, 20_000, 2)) <= most
    none = with_maybe(df, "key", keys.limit(0), "maybe")
    assert none.columns == ["id", "key", "maybe"] and none.filter("maybe").count() == 0


def test_texts_without_near_copies_are_not_exchanged(spark):
    words = lambda start: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.concat(
        F.lit("w"), (start * 50 + i).cast("string"))), " ")
    docs = spark.range(300).select(F.col("id").alias("doc_id"), words(F.col("id") % 290).alias("text"))
    docs = docs.unionByName(docs.filter("doc_id < 3"))  # repeated rows
    out = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(290))
    branches = out._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString() and branches > 2
