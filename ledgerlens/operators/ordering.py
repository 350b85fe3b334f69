"""Order-dependent operators that never sort the whole table, or one hot group, in a single task.

All follow one idea at every size. Rows are counted, which gives the number of ranges; a sample of
the sort keys, so many per range, gives their bounds. Every row finds its range by a binary search in
the bounds, so the ranges are the same in each pass over the rows, whatever ran in between. One pass
over narrow columns counts or sums each range; what the ranges before it add up to is a row per
range. The rows themselves are exchanged once, by the window inside their range.

A hash of all columns is the last sort key, so even rows equal in every given key are told apart
and dealt over several ranges, unless they are the same in all columns.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.barrier import once

# Rows of a range; a range is what one task sorts.
RANGE_ROWS = 1_000_000
# Bytes of a range, as estimated from the columns; wide rows make ranges of fewer rows.
RANGE_BYTES = 200_000_000
# Sampled keys per range: with so many a range is hardly ever twice as large as meant.
SAMPLES = 40
# A page is a plain top-n as long as all tasks together hold no more rows than this for it.
TOP_ROWS = 1_000_000
# Ranges into which one step of a deep page cuts the rows it still has to look at.
PAGE_RANGES = 200
# Whole timestamps in JSON.
_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
           "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@dataclass(frozen=True)
class Order:
    """A sort key: a column, its direction, and where its nulls stand."""

    column: Column | str
    descending: bool = False
    nulls_last: bool = False

    @property
    def value(self) -> Column:
        return F.col(f"`{self.column}`") if isinstance(self.column, str) else self.column

    @property
    def sort(self) -> Column:
        c = self.value
        if self.descending:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()

    def after(self, a: Column, b: Column) -> Column:
        """Whether value a stands behind value b."""
        null_after = F.lit(self.nulls_last)
        beyond = a < b if self.descending else a > b
        return F.when(a.isNull(), b.isNotNull() & null_after).when(
            b.isNull(), ~null_after).otherwise(beyond)


def asc(column: Column | str, nulls_last: bool = False) -> Order:
    return Order(column, False, nulls_last)


def desc(column: Column | str, nulls_last: bool = True) -> Order:
    return Order(column, True, nulls_last)


def sorts(order: Sequence[Order]) -> list[Column]:
    return [o.sort for o in order]


def _tie(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema
                        if "map<" not in f.dataType.simpleString()])


class Ranges:
    """Bounds of ranges of about equal size in an order, found in a bounded sample of the rows."""

    def __init__(self, df: DataFrame, order: Sequence[Order], rows: int, ranges: int) -> None:
        self.order, self.bounds, self.spark = list(order), [], df.sparkSession
        keys = df.select(*[o.value.alias(f"k{i}") for i, o in enumerate(order)])
        self.schema = keys.schema
        if ranges > 1:
            named = [Order(f"k{i}", o.descending, o.nulls_last) for i, o in enumerate(order)]
            sample = keys.sample(min(1.0, SAMPLES * ranges / rows), 7)
            # The sample is small, so one task sorts it, behind an exchange: coalesced, that task would also
            # read all rows. As JSON the keys go back into plans as they are.
            row = F.to_json(F.struct(*keys.columns), _FORMAT)
            ordered = sample.repartition(1).sortWithinPartitions(*sorts(named))
            found = [r[0] for r in ordered.select(row).collect()]
            at = sorted({len(found) * i // ranges for i in range(1, ranges)})
            self.bounds = list(dict.fromkeys(found[i] for i in at if i < len(found)))

    def assign(self, df: DataFrame, next_key: str | None = None) -> DataFrame:
        """Add __range, the number of bounds not behind the row, and the next bound as a struct."""
        if not self.bounds:
            df = df.withColumn("__range", F.lit(0))
            none = F.lit(None).cast(self.schema)
            return df.withColumn(next_key, none) if next_key else df
        bounds = self.literal()
        halves = [1 << i for i in reversed(range(len(self.bounds).bit_length()))]
        values = [o.value for o in self.order]

        def step(low: Column, half: Column) -> Column:
            def moved(bound: Column) -> Column:
                inside = F.lit(True)
                for i, o in reversed(list(enumerate(self.order))):
                    b = bound.getField(f"k{i}")
                    inside = o.after(values[i], b) | (values[i].eqNullSafe(b) & inside)
                return F.when((low + half <= len(self.bounds)) & inside, low + half).otherwise(low)

            # A lambda of its own names the bound once; the plan then holds the bounds once.
            return F.get(F.transform(F.array(F.get(bounds, low + half - 1)), moved), F.lit(0))

        place = F.aggregate(F.array(*[F.lit(h) for h in halves]), F.lit(0), step)
        df = once(df, __range=place)
        return df.withColumn(next_key, F.get(bounds, F.col("__range"))) if next_key else df

    def literal(self) -> Column:
        """The bounds as one constant of the plan: as a column they would be copied into every row."""
        return F.from_json(F.lit(f"[{','.join(self.bounds)}]"), T.ArrayType(self.schema), _FORMAT)


def row_bytes(df: DataFrame) -> int:
    """Rough size of a row: 8 bytes a column, and 20 more where it is no number, date or flag."""
    fixed = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    return sum(8 if isinstance(f.dataType, fixed) else 28 for f in df.schema)


def ranges_of(
    df: DataFrame, order: Sequence[Order], range_rows: int, sized_by: DataFrame | None = None,
) -> Ranges:
    rows = (df if sized_by is None else sized_by).count()
    return Ranges(df, order, rows, max(-(-rows // range_rows), -(-rows * row_bytes(df) // RANGE_BYTES)))


def global_row_number(
    df: DataFrame,
    order: Sequence[Order],
    out: str,
    restart: str | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Number all rows 1..n in the given order without a single-task sort of them all.

    With a restart column (of few values) each of its values is numbered from 1, in the same pass.
    """
    kind = [restart] if restart else []
    tied = df.withColumn("__tie", _tie(df))
    full = [*[asc(k) for k in kind], *order, asc("__tie")]
    ranges = ranges_of(tied, full, range_rows)
    placed = ranges.assign(tied)
    inside = Window.partitionBy("__range", *kind).orderBy(*sorts([*order, asc("__tie")]))
    numbered = placed.withColumn("__at", F.row_number().over(inside))
    columns = [F.col(f"`{c}`") for c in df.columns]
    if not ranges.bounds:
        return numbered.select(*columns, F.col("__at").cast("bigint").alias(out))
    sizes = placed.groupBy("__range", *kind).count().orderBy("__range").collect()
    before: dict = {}
    starts = []
    for r in sizes:
        own = r[restart] if restart else None
        starts.append((r["__range"], own, before.get(own, 0)))
        before[own] = before.get(own, 0) + r["count"]
    schema = T.StructType([
        T.StructField("__r", T.IntegerType()),
        T.StructField("__kind", df.schema[restart].dataType if restart else T.IntegerType()),
        T.StructField("__start", T.LongType())])
    side = F.broadcast(df.sparkSession.createDataFrame(starts, schema))  # a row per range and kind
    same = F.col("__range") == F.col("__r")
    if restart:
        same = same & F.col(f"`{restart}`").eqNullSafe(F.col("__kind"))
    return numbered.join(side, same).select(
        *columns, (F.col("__start") + F.col("__at")).cast("bigint").alias(out))


def _carried(ranges: Ranges, totals: dict[int, list], n_keys: int, n_sums: int) -> list[tuple]:
    """(range, sums): what earlier ranges hold of the key that each range begins with."""
    def key(bound: str) -> list:
        row = json.loads(bound)
        return [row.get(f"k{i}") for i in range(n_keys)]

    out, now, last = [], [None] * n_sums, None
    for at, own in enumerate(map(key, ranges.bounds)):
        if own != last:
            now, last = [None] * n_sums, own
        more = totals.get(at, [None] * n_sums)
        now = [b if a is None else a if b is None else a + b for a, b in zip(now, more)]
        out.append((at + 1, *now))
    return out


def running_sums(
    df: DataFrame,
    sums: dict[str, Column],
    keys: Sequence[str],
    order: Sequence[Order],
    range_rows: int = RANGE_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Add running sums per key group in the given order, from the first row to the current one.

    A group that goes over several ranges carries its sums from one to the next, so a hot group is
    summed by many tasks. When df is costly, pass a cheaper frame of as many rows as sized_by.
    """
    names = list(sums)
    valued = df.withColumns({f"__v{i}": v for i, v in enumerate(sums.values())})
    valued = valued.withColumn("__tie", _tie(df))
    ranges = ranges_of(valued, [*[asc(k) for k in keys], *order, asc("__tie")], range_rows, sized_by)
    placed = ranges.assign(valued)
    inside = Window.partitionBy("__range", *keys).orderBy(*sorts([*order, asc("__tie")]))
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = [F.col(f"`{c}`") for c in df.columns]
    local = [F.sum(f"__v{i}").over(inside) for i in range(len(names))]
    if not ranges.bounds:
        return placed.select(*columns, *[v.alias(c) for v, c in zip(local, names)])

    # Of each range only the key that goes on into the next one is needed.
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__next.k{i}"))
    ends = ranges.assign(valued, "__next").filter(F.col("__next").isNotNull() & same)
    totals = ends.groupBy("__range").agg(*[F.sum(f"__v{i}").alias(f"__o{i}") for i in range(len(names))])
    found = {r["__range"]: list(r[1:]) for r in totals.collect()}
    schema = T.StructType([T.StructField("__r", T.IntegerType()), *totals.schema.fields[1:]])
    carried = df.sparkSession.createDataFrame(_carried(ranges, found, len(keys), len(names)), schema)
    # The first key of a range, the only one with a sum from before it.
    first = F.get(ranges.literal(), F.col("__r") - 1)
    side = F.broadcast(carried.withColumn("__first", first))  # a row per range
    begins = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        begins = begins & F.col(f"`{k}`").eqNullSafe(F.col(f"__first.k{i}"))
    summed = placed.select("*", *[v.alias(f"__l{i}") for i, v in enumerate(local)])
    total = lambda i: F.coalesce(
        F.col(f"__l{i}") + F.col(f"__o{i}"), F.col(f"__l{i}"), F.col(f"__o{i}"))
    return summed.join(side, begins, "left").select(
        *columns, *[total(i).alias(c) for i, c in enumerate(names)])


def sort_columns(
    sort_by: str, direction: str, allowed: Sequence[str], default: str, tie: Sequence[str]
) -> list[Order]:
    """Order by a permitted column (else the default), NULLs last both ways, then a unique tie."""
    column = sort_by if sort_by in allowed else default
    return [Order(column, direction.upper() != "ASC", True), *[asc(t) for t in tie]]


def page(
    df: DataFrame, order: Sequence[Order], number: int, size: int, top_rows: int = TOP_ROWS
) -> DataFrame:
    """Page `number` (from 1); see window_of_rows."""
    return window_of_rows(df, order, (number - 1) * size, size, top_rows)


def window_of_rows(
    df: DataFrame,
    order: Sequence[Order],
    offset: int,
    limit: int,
    top_rows: int = TOP_ROWS,
    page_ranges: int = PAGE_RANGES,
) -> DataFrame:
    """The rows from `offset` on, at most `limit` of them, in order.

    As long as a plain top-n would have the tasks hold more than top_rows rows, the sort keys are
    counted by ranges, and only the ranges that hold the page are looked at further: each step reads
    narrow columns once and leaves about a page_ranges-th of the rows.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = [*order, asc("__tie")]
    rows = df.withColumn("__tie", _tie(df))
    left = None
    while (offset + limit) * tasks > top_rows:
        if left is None:
            left = rows.count()
        ranges = Ranges(rows, full, left, min(page_ranges, left))
        placed = ranges.assign(rows)
        sizes = dict(placed.groupBy("__range").count().collect())
        first = last = before = seen = 0
        for at in sorted(sizes):
            if seen <= offset:
                first, before = at, seen
            if seen < offset + limit:
                last = at
            seen += sizes[at]
        wanted = {at: n for at, n in sizes.items() if first <= at <= last}
        if sum(wanted.values()) >= left:
            break  # the page is all that is left, or rows the same in all columns
        rows = placed.filter(F.col("__range").between(first, last)).drop("__range")
        left, offset = sum(wanted.values()), offset - before
    return rows.orderBy(*sorts(full)).offset(offset).limit(limit).drop("__tie")


def total_pages(total: int, size: int) -> int:
    return math.ceil(total / size) if total > 0 else 0


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)
