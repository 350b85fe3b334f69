"""Keyed merges: upserts, overlays, first or last row per key, status propagation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys with more rows than this are looked up by several tasks.
HOT_ROWS = 1_000_000
# Parts over which rows without a key are spread.
SALTS = 100_000
# The column by which readers of landed files tell the order in which records came.
ARRIVAL = "__arrival"


def _columns(df: DataFrame, skip: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(skip)]


def best_per_key(
    df: DataFrame, keys: Sequence[str], rank: Sequence[Column], latest: bool = True
) -> DataFrame:
    """One row per key, the one with the highest (or lowest) rank.

    An aggregate, not a window: each task first reduces its own rows, so a hot key costs nothing.
    """
    rest = _columns(df, keys)
    if not rest:
        return df.distinct()
    payload = F.struct(*[F.col(f"`{c}`") for c in rest])
    pick = F.max_by if latest else F.min_by
    best = df.groupBy(*keys).agg(pick(payload, F.struct(*rank)).alias("__best"))
    return best.select(*keys, *[F.col("__best")[c].alias(c) for c in rest]).select(*df.columns)


def arrival(df: DataFrame) -> list[str]:
    """The column of the order of arrival, if the frame has it."""
    return [ARRIVAL] if ARRIVAL in df.columns else []


def last_writes(df: DataFrame, keys: Sequence[str], sequence: str | None = None) -> DataFrame:
    """One row per key: the last by the sequence column, or else by the order of arrival.

    Rows equal in both are the same write repeated, of which the greatest by its values counts. A
    frame with neither must hold each key once; a second row of a key ends the job, as nothing says
    which came last.
    """
    sequence = sequence or next(iter(arrival(df)), None)
    if sequence:
        rest = [F.col(f"`{f.name}`") for f in df.schema if f.name not in {*keys, sequence}
                and "map<" not in f.dataType.simpleString()]
        return best_per_key(df, keys, [F.col(f"`{sequence}`"), *rest]).drop(sequence)
    rest = _columns(df, keys)
    row = F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(1).alias("__one"))
    one = df.groupBy(*keys).agg(F.any_value(row).alias("__row"), F.count(F.lit(1)).alias("__n"))
    known = F.when(F.col("__n") == 1, F.col("__row")).otherwise(F.raise_error(
        F.lit(f"several rows of one {', '.join(keys)}, and no sequence to tell the last")))
    return one.withColumn("__row", known).select(
        *keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    sequence: str | None = None,
    insert: bool = True,
) -> DataFrame:
    """Insert or update by key (or only update); only columns present in the updates change.

    Repeated keys in the updates are reduced to the last write first; see last_writes.
    """
    target = target.drop(ARRIVAL)
    updates = last_writes(updates, keys, sequence)
    changed = [c for c in _columns(updates, keys) if c in target.columns]
    new = updates.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[F.col(c).alias(f"__u_{c}") for c in changed],
        F.lit(True).alias("__hit"),
    )
    same = [F.col(f"`{k}`") == F.col(f"__k_{k}") for k in keys]
    merged = target.join(new, same, "full_outer" if insert else "left")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.coalesce(F.col(f"`{c}`"), F.col(f"__k_{c}")).alias(c))
        elif c in changed:
            out.append(F.when(F.col("__hit"), F.col(f"__u_{c}")).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return merged.select(*out)


def overlay(
    base: DataFrame, detail: DataFrame, keys: Sequence[str], sequence: str | None = None
) -> DataFrame:
    """Columns of the detail row win where they are neither NULL nor empty; base rows all stay.

    Of several details of a key the last write counts; see last_writes.
    """
    base = base.drop(ARRIVAL)
    detail = last_writes(detail, keys, sequence)
    shared = [c for c in _columns(detail, keys) if c in base.columns]
    extra = [c for c in _columns(detail, keys) if c not in base.columns]
    side = detail.select(
        *keys, *[F.col(c).alias(f"__d_{c}") for c in shared], *[F.col(c) for c in extra]
    )
    joined = base.join(side, list(keys), "left")
    text = {f.name for f in detail.schema if f.dataType.simpleString() == "string"}
    out = []
    for c in base.columns:
        if c not in shared:
            out.append(F.col(f"`{c}`"))
            continue
        d = F.col(f"__d_{c}")
        d = F.when(d != "", d) if c in text else d
        out.append(F.coalesce(d, F.col(f"`{c}`")).alias(c))
    return joined.select(*out, *[F.col(c) for c in extra])


def lookup(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, hot_rows: int = HOT_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Left join to a table with one row per key, whatever the skew of the left keys.

    A key with more than hot_rows rows is cut into as many parts as it has hot_rows: its rows take
    one by a hash of their values, the same on a rerun, and its row on the right is repeated for each
    part. Rows without a key match nothing and are spread. The list of such keys holds no more than
    rows / hot_rows of them, so it is broadcast. When left is costly, pass a cheaper frame with the
    same keys as sized_by.
    """
    k, values = F.col(f"`{left_key}`"), _columns(right, [right_key])
    keyed = (left if sized_by is None else sized_by).filter(k.isNotNull())
    sizes = keyed.groupBy(k.alias("__hot")).agg(F.count(F.lit(1)).alias("__n"))
    parts = F.ceil(F.col("__n") / F.lit(hot_rows)).cast("int").alias("__parts")
    hot = F.broadcast(sizes.filter(F.col("__n") > hot_rows).select("__hot", parts))

    hashable = [F.col(f"`{f.name}`") for f in left.schema if "map<" not in f.dataType.simpleString()]
    spread = F.when(k.isNull(), F.lit(SALTS)).otherwise(F.coalesce("__parts", F.lit(1)))
    salted = left.join(hot, k == F.col("__hot"), "left").withColumn(
        "__part", F.pmod(F.xxhash64(*hashable), spread).cast("int")).drop("__hot", "__parts")
    side = right.join(hot, F.col(f"`{right_key}`") == F.col("__hot"), "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    joined = salted.join(side, (k == F.col(f"`{right_key}`")) & (F.col("__part") == F.col("__salt")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in left.columns + values])


def first_wins(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of lists in order; for a repeated key the row of the earliest list stays."""
    ranked = [f.withColumn("__rank", F.lit(i)) for i, f in enumerate(frames)]
    union = ranked[0]
    for f in ranked[1:]:
        union = union.unionByName(f)
    order = [F.col("__rank"), *[F.col(f"`{c}`") for c in _columns(frames[0], keys)]]
    return best_per_key(union, keys, order, latest=False).drop("__rank")


def propagate_last(
    target: DataFrame,
    key: str,
    column: str,
    sources: DataFrame,
    target_ids: Column,
    value: Column,
    rank: Sequence[Column],
) -> DataFrame:
    """Push the last non-empty value of the sources to every target row they point at."""
    hits = (
        sources.select(
            F.explode(target_ids).alias("__id"), value.alias("__value"), F.struct(*rank).alias("__r")
        )
        .filter((F.col("__value") != "") & (F.col("__id").cast("string") != ""))
        .groupBy("__id")
        .agg(F.max_by("__value", "__r").alias("__value"))
    )
    joined = target.join(hits, F.col(f"`{key}`") == F.col("__id"), "left")
    new = F.coalesce(F.col("__value"), F.col(f"`{column}`")).alias(column)
    return joined.select(*[new if c == column else F.col(f"`{c}`") for c in target.columns])
