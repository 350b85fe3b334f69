"""Registration of queries and their SQL, and small helpers to load and flatten tables."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Dates the test data is looked at from.
REF_DATE = dt.date(1997, 6, 30)
NOW = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)


class Tables:
    """The Parquet tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame`; dates and flags of the result become text and numbers."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(fn(Tables(spark, folder)))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, booleans as 0/1, so that every engine prints them alike."""
    casts = {"date": "string", "timestamp": "string", "timestamp_ntz": "string", "boolean": "int"}
    if not any(t in casts for _, t in df.dtypes):
        return df
    return df.select(*[
        F.col(f"`{c}`").cast(casts[t]).alias(c) if t in casts else F.col(f"`{c}`")
        for c, t in df.dtypes
    ])


def orders_dated(t: Tables) -> DataFrame:
    """Orders with a date and an amount in whole cents."""
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.to_date("o_orderdate").alias("d"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )


ORDERS_DATED = """(SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
    CAST(o_orderdate AS DATE) AS d, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
    FROM orders)"""


def period_sql(date: str, ref: dt.date = REF_DATE) -> str:
    """The half-year label in SQL: twice the years, and one more from July on."""
    half = f"(2 * year({date}) + CASE WHEN month({date}) > 6 THEN 1 ELSE 0 END)"
    now = 2 * ref.year + (1 if ref.month > 6 else 0)
    return f"""CASE WHEN {date} IS NULL THEN '請求日未入力' WHEN {half} = {now} THEN '今期'
        WHEN {half} = {now - 1} THEN '前期'
        ELSE CAST({half} - {2 * 2024 - 36} AS VARCHAR) || '.0期' END"""
