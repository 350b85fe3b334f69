"""Run queries in Spark and their SQL in DuckDB and compare the rows, whatever their order."""

from __future__ import annotations

import glob
import os
import time
from decimal import Decimal

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(f).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def cell(v):
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.6g}" if v == v else "nan"
    return repr(v)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, folder) -> tuple[str | None, int, float]:
    """(difference or None, number of rows, Spark seconds)."""
    start = time.time()
    df = fn(spark, folder)
    got = df.collect()
    took = time.time() - start
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}", len(got), took
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}", len(a), took
    for x, y in zip(a, b):
        if x != y:
            diff = [(c, p, q) for c, p, q in zip(sorted(df.columns), x, y) if p != q]
            return f"first difference {diff[:3]} in {x[:6]}", len(a), took
    return None, len(a), took
