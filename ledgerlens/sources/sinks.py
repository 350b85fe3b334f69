"""Writers: CSV exports, replaced and appended Parquet tables, and row counts per step."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.files import path_exists

UTF8_BOM = "﻿"


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV part files with a header; with bom each header starts with a byte-order mark."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], UTF8_BOM + df.columns[0])
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
       .option("emptyValue", "").csv(path))


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a Parquet table in place of the old one. The plan must not read the same path."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [n for n in names if n.startswith("snapshot=")
            and path_exists(spark, os.path.join(path, n, "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest completely written snapshot of a table."""
    done = _snapshots(spark, path)
    return spark.read.parquet(os.path.join(path, f"snapshot={done[-1]}")) if done else None


def write_snapshot(df: DataFrame, path: str) -> int:
    """Write the next snapshot; the plan may read the current one (upserts do)."""
    done = _snapshots(df.sparkSession, path)
    version = (done[-1] + 1) if done else 1
    df.write.mode("overwrite").parquet(os.path.join(path, f"snapshot={version}"))
    return version


class StepCounts:
    """Row counts per step, observed while the job runs instead of counted in extra jobs."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, step: str, df: DataFrame) -> DataFrame:
        self._seen[step] = Observation(step)
        return df.observe(self._seen[step], F.count(F.lit(1)).alias("rows"))

    def result(self) -> dict[str, int]:
        """Call after an action on every watched frame."""
        return {step: seen.get["rows"] for step, seen in self._seen.items()}


def input_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows, columns) of each input."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns")
        )
        out = one if out is None else out.unionByName(one)
    return out
