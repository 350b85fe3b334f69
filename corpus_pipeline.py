"""The training-data pipeline: each stage works on all documents its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, neardup, packing, quality, substrings
from ledgerlens.llm.registry import table
from ledgerlens.llm.sieve import with_maybe
from ledgerlens.llm.tokens import word_tokenizer_path
from ledgerlens.session import pin, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.judge(docs, into="__q").filter("__q.kept").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, the document with the least id stays; of equal rows, one.

    Rows that are their key's only one and stay are not exchanged; the others are looked up.
    """
    groups = neardup.find_groups(docs, row_key="__key")
    keys = pin(groups.groupBy("__key").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("kept").alias("kept")).filter("n > 1 OR NOT kept"))
    keyed = docs.withColumn("__key", neardup.row_key_of("doc_id", "text"))
    keyed = with_maybe(keyed, "__key", keys.select("__key"), "__maybe")
    known = keys.withColumnRenamed("__key", "__k")
    looked_up = keyed.filter("__maybe").join(known, F.col("__key") == F.col("__k"), "left")
    # Of a key with several rows, one stays; a row whose key is not listed was taken for another.
    left = looked_up.filter("__k IS NULL OR kept").dropDuplicates(["__key"])
    return keyed.filter("NOT __maybe").select(*docs.columns).union(left.select(*docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur in more than one place are cut; a text of nothing else goes."""
    cut = substrings.remove_repeats(docs, into="__d")
    left = cut.filter("__d.n_removed = 0 OR __d.n_removed < __d.n_words")
    text = F.col("__d.text")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return left.select(*[
        new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents a twentieth of whose words lie in passages of the benchmark go."""
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), into="__c")
    return found.filter(~decontamination.contaminated("__c")).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in windows of the corpus' own mixture of sources."""
    return packing.pack(docs, word_tokenizer_path(), keep=["doc_id", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("minhash_near_dedup", keep_one_of_each),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_benchmark_copies),
    ("mixture_packing", pack_windows),
]
# Sketches, automata and tokenising have no SQL form; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
