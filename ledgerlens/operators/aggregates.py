"""Grouped counts, distinct lists, column profiles and filter values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.casts import blank_to

# Registers of a distinct-count sketch, as a power of two.
SKETCH_LG_K = 14


def count_by(df: DataFrame, *keys: str, out: str = "count", k: int | None = None) -> DataFrame:
    """Rows per key combination, most frequent first, optionally the top k."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    ordered = counted.orderBy(F.desc(out), *[F.col(f"`{c}`").asc_nulls_last() for c in keys])
    return ordered if k is None else ordered.limit(k)


def count_and_sum(df: DataFrame, keys: Sequence[str], value: Column, count: str, total: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(count), F.coalesce(F.sum(value), F.lit(0)).alias(total)
    )


def child_counts(df: DataFrame, parent: str, child: str, out: str) -> DataFrame:
    has_parent = df.filter(F.col(f"`{parent}`").isNotNull())
    return has_parent.groupBy(parent).agg(F.count(F.col(f"`{child}`")).alias(out))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values, NULL and blank dropped."""
    return df.select(column).filter(F.col(column) != "").distinct().orderBy(column)


def state_counts(df: DataFrame, state: Column, out: str = "state") -> DataFrame:
    return count_by(df.select(blank_to(state, "UNKNOWN").alias(out)), out)


def _as_text(df: DataFrame, column: str) -> Column:
    """A text that tells the values of a column apart."""
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0)).cast("string")  # one zero only
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(c.isNotNull(), F.to_json(F.struct(c)))
    return c.cast("string")


def column_profile(df: DataFrame, samples: int = 3, order: Sequence[Column] | None = None) -> DataFrame:
    """One row per column: type, rows, NULLs, exact distinct values, and a few sample values.

    Two levels of counts: of each value of each column, reduced by every task before the shuffle,
    and of each column over these. The samples come from the first rows.
    """
    names = df.columns
    head = df.orderBy(*order).limit(samples) if order else df.limit(samples)
    taken = head.select([F.col(f"`{c}`").cast("string") for c in names]).collect()
    shapes = df.sparkSession.createDataFrame(
        [(i, c, t, [r[i] for r in taken]) for i, (c, t) in enumerate(df.dtypes)],
        "__at int, name string, type string, samples array<string>")
    cells = F.array(*[F.struct(F.lit(i).alias("__at"), _as_text(df, c).alias("value"))
                      for i, c in enumerate(names)])
    values = df.select(F.inline(cells)).groupBy("__at", "value").agg(F.count(F.lit(1)).alias("n"))
    found = values.groupBy("__at").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("nulls"),
        F.count("value").alias("distinct"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    # A row per column on both sides.
    return F.broadcast(shapes).join(found, "__at", "left").select(
        "name", "type", zero("total").alias("total_rows"), zero("nulls").alias("null_count"),
        zero("distinct").alias("distinct_count"), "samples")


def column_sketches(df: DataFrame, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """(name, total_rows, null_count, sketch) per column, from one scan and no shuffle of values.

    Sketches of parts of a table, made at any time, can be stored and merged: see merged_sketches.
    """
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(F.col(f"`{c}`").isNull()).alias(f"__null{i}"))
        aggs.append(F.hll_sketch_agg(_as_text(df, c), F.lit(lg_k)).alias(f"__sketch{i}"))
    cells = [F.struct(F.lit(c).alias("name"), F.col("__rows").alias("total_rows"),
                      F.col(f"__null{i}").alias("null_count"), F.col(f"__sketch{i}").alias("sketch"))
             for i, c in enumerate(df.columns)]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def merged_sketches(parts: DataFrame) -> DataFrame:
    """Column sketches of several parts as those of the whole, with the distinct values estimated.

    The standard error is about 0.8 % with the default size of a sketch.
    """
    merged = parts.groupBy("name").agg(
        F.sum("total_rows").alias("total_rows"), F.sum("null_count").alias("null_count"),
        F.hll_union_agg("sketch").alias("sketch"))
    return merged.withColumn("approx_distinct", F.hll_sketch_estimate("sketch"))


def filter_values(df: DataFrame, columns: Sequence[str], max_distinct: int = 200) -> DataFrame:
    """(column, value, count) for listed columns with few enough distinct values.

    All columns are counted in one pass. The distinct count (blank included, NULL not) is a second
    aggregate of the first and has one row per listed column.
    """
    listed = [c for c in columns if c in df.columns]
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in listed
    ])
    # Both uses of the counted rows read the same aggregates, so that they are computed only once.
    counted = (
        df.select(F.inline(cells))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"), F.max(F.col("value") != "").alias("__shown"))
    )
    few = (
        counted.groupBy("column")
        .agg(F.sum(F.least("count", F.lit(1))).alias("__distinct"), F.max("__shown").alias("__any"))
        .filter((F.col("__distinct") <= max_distinct) & F.col("__any").isNotNull())
        .select("column")
    )
    kept = counted.join(F.broadcast(few), "column").filter("__shown")
    return kept.select("column", "value", "count")
