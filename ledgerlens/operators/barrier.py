"""Columns computed once per row, however often later steps use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns, or replace those of the same names, behind a step that the optimizer keeps.

    Neighbouring projections and filters are merged, which evaluates a costly expression anew for
    each of its uses. A generator of one row between them is not merged with either.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    own = df.select("*", F.explode(F.array(row)).alias("__once"))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return own.select(*kept, *[F.col(f"__once.{n}").alias(n) for n in columns])
