"""Readers: CSV inputs by logical name, landed JSON lines, and persisted result tables."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ledgerlens.operators.barrier import once
from ledgerlens.operators.merging import ARRIVAL


def text_schema(columns: Sequence[str]) -> T.StructType:
    """Every CSV column is read as text; types are decided by forgiving casts afterwards."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV with a header row, quoted line breaks included; malformed rows are skipped, whichever
    columns a query selects.

    Files are read line by line in splits, by many tasks. Whether a line begins inside a quoted
    cell follows from the quotes before it: each split counts its own, a row per split is summed up
    in file order, and only lines of records that go over several are joined again.
    """
    lines = _placed_lines(spark, path)
    return _parsed(lines, schema)


def _placed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole records as __record; the header of each file is left out."""
    text = spark.read.text(path).select(
        F.regexp_replace("value", "\r$", "").alias("__line"), F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__row"))
    odd = (F.length("__line") - F.length(F.replace("__line", F.lit('"'), F.lit("")))) % 2
    text = text.withColumn("__odd", odd.cast("long"))
    here = ["__file", "__split"]
    # Of each split: its quotes, and the rows of its last line that begins a record, whether the
    # split itself begins inside quotes or not.
    running = F.sum("__odd").over(
        Window.partitionBy(*here).orderBy("__row").rowsBetween(Window.unboundedPreceding, -1))
    local = text.withColumn("__before", F.coalesce(running, F.lit(0)) % 2)
    last = lambda parity: F.max(F.when(F.col("__before") == parity, F.col("__row")))
    splits = local.groupBy(*here).agg(
        F.sum("__odd").alias("odd"), last(0).alias("even_last"), last(1).alias("odd_last"),
        F.min("__row").alias("top"))
    earlier = Window.partitionBy("__file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    entered = splits.withColumn("__in", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    own = F.struct("__split", F.when(F.col("__in") == 0, F.col("even_last")).otherwise(F.col("odd_last")).alias("row"))
    begun = F.max(F.when(own["row"].isNotNull(), own)).over(earlier)
    starts = entered.select(
        *here, "__in", begun.alias("__open"),
        (F.row_number().over(Window.partitionBy("__file").orderBy("__split")) == 1).alias("__first"), "top")
    # A row per split, and a split is at least a block of a file.
    known = local.join(F.broadcast(starts), here)
    begins = (F.col("__before") + F.col("__in")) % 2 == 0
    whole = begins & (F.col("__odd") == 0)
    header = F.col("__first") & (F.col("__row") == F.col("top"))
    single = known.filter(whole & ~header).select(F.col("__line").alias("__record"))
    parts = known.filter(~whole).withColumn("__begins", begins)
    mark = F.when(F.col("__begins"), F.struct("__split", F.col("__row").alias("row")))
    since = F.max(mark).over(Window.partitionBy(*here).orderBy("__row").rowsBetween(Window.unboundedPreceding, 0))
    joined = parts.withColumn("__of", F.coalesce(since, "__open")).groupBy("__file", "__of").agg(
        F.sort_array(F.collect_list(F.struct("__split", "__row", "__line"))).alias("p"),
        F.max(F.col("__begins") & header).alias("__header"))
    several = joined.filter(~F.col("__header")).select(
        F.array_join(F.transform("p", lambda x: x["__line"]), "\n").alias("__record"))
    return single.unionAll(several)


def _parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    broken = "__broken"
    full = T.StructType([*schema.fields, T.StructField(broken, T.StringType())])
    row = F.from_csv("__record", _ddl(full), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken, "escape": '"', "multiLine": "true"})
    # An empty line is no row.
    made = once(lines.filter(F.trim("__record") != ""), __r=row)
    return made.filter(F.col(f"__r.{broken}").isNull()).select(
        *[F.col(f"__r.`{f.name}`").alias(f.name) for f in schema])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def read_csv_named(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Pick columns by header name, whatever their order or the extra columns around them."""
    header = spark.read.option("header", True).option("escape", '"').csv(path).columns
    missing = [c for c in columns if c not in header]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    df = read_csv(spark, path, text_schema(header))
    return df.select(*[df[f"`{c}`"] for c in columns])


def read_config(spark: SparkSession, path: str) -> dict:
    """A report's configuration document: name, cards, and inputs of {"name", "file"}."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return json.loads(text)


def input_files(config: Mapping) -> dict[str, str]:
    return {entry["name"]: entry["file"] for entry in config["inputs"]}


def load_inputs(
    spark: SparkSession,
    folder: str,
    files: Mapping[str, str],
    columns: Mapping[str, Sequence[str]],
) -> dict[str, DataFrame]:
    """Logical table name to DataFrame; a table without a configured or readable file is an error."""
    tables = {}
    for name, wanted in columns.items():
        if name not in files:
            raise ValueError(f"no file configured for input table '{name}'")
        try:
            df = read_csv_named(spark, os.path.join(folder, files[name]), wanted)
        except AnalysisException as e:
            raise FileNotFoundError(f"input table '{name}': cannot read {files[name]}") from e
        df.createOrReplaceTempView(name)
        tables[name] = df
    return tables


def read_json_lines(
    spark: SparkSession, path: str | list[str], schema: T.StructType, arrival: bool = False
) -> DataFrame:
    """Landed JSON lines; with arrival also the order in which they came, for last write wins.

    Files come in the order of their paths, the lines of a file from the first on. A split of a
    file is read from its start to its end by one task, so the splits' offsets and the row ids
    inside a task tell the order, whichever tasks read them.
    """
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if not arrival:
        return rows
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias(ARRIVAL))


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A persisted Parquet table, or None when it has not been written yet."""
    return spark.read.parquet(path) if path_exists(spark, os.path.join(path, "_SUCCESS")) else None
