"""URL filters: dated list entries as validity intervals, and an as-of join of every capture.

Only built-in functions. Captures are reduced to distinct (host, time) before they meet the list,
so a host's many captures of one moment are judged once, and rejoin by both columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAR = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.lower(host), F.lit(""))


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, list, since, until): from an add to the next entry of its pattern and list.

    entries: pattern, list, action (add or remove), day. Of entries of one day a removal counts.
    Entries with a null are skipped, repeated adds continue the first.
    """
    days = entries.dropna(subset=["pattern", "list", "action", "day"]).groupBy(
        F.lower("pattern").alias("pattern"), "list", F.to_date("day").alias("day")).agg(
        F.max(F.col("action") == "remove").alias("removed"))
    w = Window.partitionBy("pattern", "list").orderBy("day")
    until = F.coalesce(F.lead("day").over(w), F.to_date(F.lit(FAR)))
    return days.withColumn("until", until).filter("NOT removed").select(
        "pattern", "list", F.col("day").alias("since"), "until")


def judge(
    captures: DataFrame, entries: DataFrame, into: str = "url_filter",
    url_column: str = "url", day_column: str = "day", keep: list[str] | None = None,
) -> DataFrame:
    """Add a struct: host, n_active, the deciding pattern and list, and kept.

    An entry's pattern is a host or a parent domain; it is active from its day until the day of
    the next entry of the same pattern and list. Of the entries active at a capture's day that
    match its host, the one of most labels decides, `allow` before any other list on a tie, then
    the least list name. kept: none is active, or an allow entry decides.

    A capture without a host or day matches nothing and is kept. Repeated captures get equal
    results; an empty list keeps all; no captures give no rows. An input column named as `into` is
    replaced, others pass unchanged.
    """
    columns = [c for c in (captures.columns if keep is None else keep) if c.lower() != into.lower()]
    seen = captures.select(
        *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(columns)],
        host_of(F.col(f"`{url_column}`")).alias("__host"),
        F.to_date(F.col(f"`{day_column}`")).alias("__day"))
    moments = seen.select("__host", "__day").dropna().distinct()
    # Every suffix of each distinct host, met by the list's intervals once.
    labels = F.split("host", r"\.")
    suffix = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(
            F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern"),
            (F.size(labels) - i + 1).alias("labels")))
    hosts = moments.select(F.col("__host").alias("host")).distinct()
    spans = (
        hosts.select("host", F.explode(suffix).alias("s")).select("host", "s.pattern", "s.labels")
        .join(validity(entries), "pattern"))
    active = moments.join(spans, (F.col("__host") == F.col("host")) & (
        F.col("since") <= F.col("__day")) & (F.col("__day") < F.col("until")))
    rank = F.struct(
        -F.col("labels"), F.when(F.col("list") == "allow", 0).otherwise(1), F.col("list"), "pattern")
    best = active.groupBy(F.col("__host").alias("h"), F.col("__day").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.min(rank).alias("b"))
    joined = seen.join(best, (F.col("__host") == F.col("h")) & (F.col("__day") == F.col("d")), "left")
    result = F.struct(
        F.col("__host").alias("host"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
        F.col("b.pattern").alias("pattern"), F.col("b.list").alias("list"),
        F.coalesce(F.col("b.list") == "allow", F.lit(True)).alias("kept"))
    return joined.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(columns)], result.alias(into))
