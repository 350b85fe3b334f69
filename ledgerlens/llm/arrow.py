"""Small helpers for operators that work on Arrow batches inside Spark's tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows handled at once in Python; Spark's own batches hold ten thousand.
SLICE_ROWS = 500


def others(columns: Sequence[str], into: str) -> list[str]:
    """The columns that stay beside the result column; one of the same name is replaced."""
    return [c for c in columns if c.lower() != into.lower()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def add_struct(
    df: DataFrame,
    into: str,
    result: T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch], list[dict | tuple]]],
    inputs: Sequence[str],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add one struct column `into`, computed batch by batch from the `inputs` columns.

    `make()` runs once per task and returns the function from a batch with the columns of
    `inputs`, under these names, to a list of structs. `keep` names the input columns to return
    (default: all); an input column called `into` is replaced.
    """
    kept = others(df.columns if keep is None else keep, into)
    given = [F.col(f"`{c}`").alias(f"__i{k}") for k, c in enumerate(inputs)]
    stay = [F.col(f"`{c}`").alias(f"__k{k}") for k, c in enumerate(kept)]
    narrow = df.select(*stay, *given)
    schema = T.StructType([*narrow.schema.fields[: len(kept)], T.StructField("__r", result)])
    n, names, labels = len(kept), list(inputs), narrow.columns[: len(kept)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        step, kind = make(), to_arrow_type(result)
        for batch in slices(batches):
            own = pa.RecordBatch.from_arrays(batch.columns[n:], names=names)
            out = pa.array(step(own), type=kind)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], out], names=[*labels, "__r"])

    done = narrow.mapInArrow(work, schema)
    return done.select(
        *[F.col(f"__k{k}").alias(c) for k, c in enumerate(kept)], F.col("__r").alias(into))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of each text without decoding it."""
    return column.cast(pa.binary()).to_pylist()


_TYPES = {
    "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(),
    "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(),
}


def row_type(**fields: str) -> T.StructType:
    """A schema by names of types; unlike DDL text it can be made inside a task."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in fields.items()])


def to_table(rows: Sequence[Sequence], schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_type

    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table(
        [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, schema)],
        names=schema.names)
