"""Card and dashboard usage: lists, dashboards, statistics, low usage, and view refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ledgerlens.functions.predicates import equals_ci, low_usage, search, where_all
from ledgerlens.operators.aggregates import count_and_sum, distinct_values
from ledgerlens.operators.merging import arrival, upsert
from ledgerlens.operators.ordering import asc, page, sort_columns, top, window_of_rows

# Sortable columns and list lengths.
CARD_SORTS = ("view_count", "title", "card_type", "page_title", "owner_name", "last_viewed_at")
DASHBOARD_SORTS = ("total_views", "card_count", "page_title")
TOP_TYPES = 10
TOP_DASHBOARDS = 10
TOP_OWNERS = 20


def card_table(summary: DataFrame) -> DataFrame:
    """Cards from landed summaries: first page, first owner, no views yet."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    page_of, owner = F.get("pageHierarchy", F.lit(0)), F.get("owners", F.lit(0))
    return summary.select(
        "id", blank(F.col("title")).alias("title"), blank(F.col("type")).alias("card_type"),
        F.lit(0).cast("bigint").alias("view_count"),
        F.lit(None).cast("timestamp").alias("last_viewed_at"),
        blank(owner["displayName"]).alias("owner_name"),
        page_of["pageId"].alias("page_id"), blank(page_of["title"]).alias("page_title"),
        F.lit(None).cast("string").alias("datasource_id"),
        F.lit(None).cast("string").alias("datasource_name"),
    )


def view_updates(info: DataFrame) -> DataFrame:
    """Views, last view (0 means never) and first data source per card."""
    source = F.get("datasources", F.lit(0))
    last = F.col("viewInfo.lastViewedDate")
    return info.filter(F.col("id") != "").select(
        "id",
        F.coalesce("viewInfo.totalViewCount", F.lit(0)).alias("view_count"),
        F.when(last > 0, F.timestamp_millis(last)).alias("last_viewed_at"),
        source["dataSourceId"].alias("datasource_id"),
        source["dataSourceName"].alias("datasource_name"), *arrival(info),
    )


def refresh_view_counts(cards: DataFrame, info: DataFrame) -> DataFrame:
    """Existing cards updated by the last info record of each; unknown cards are not added."""
    return upsert(cards, view_updates(info), ["id"], insert=False)


def card_list(
    cards: DataFrame, text: str = "", card_type: str = "", page_title: str = "", owner: str = "",
    sort_by: str = "view_count", direction: str = "DESC", number: int = 1, size: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """One page of cards and the total number found."""
    wanted = search(
        {"title": text, "page_title": page_title, "owner_name": owner}, {"card_type": card_type}
    )
    hits = where_all(cards, wanted)
    order = sort_columns(sort_by, direction, CARD_SORTS, "view_count", ["id"])
    return page(hits, order, number, size), hits.agg(F.count(F.lit(1)).alias("total"))


def card_types(cards: DataFrame) -> DataFrame:
    return distinct_values(cards, "card_type")


def _on_pages(cards: DataFrame, text: str) -> DataFrame:
    shown = F.col("page_id").isNotNull() & (F.col("page_title") != "")
    return where_all(cards, [shown, *search({"page_title": text}, {})])


def dashboard_grid(cards: DataFrame, text: str = "") -> DataFrame:
    return count_and_sum(
        _on_pages(cards, text), ["page_id", "page_title"], F.col("view_count"),
        "card_count", "total_views",
    )


def dashboards(
    cards: DataFrame, text: str = "", sort_by: str = "total_views", direction: str = "DESC",
    number: int = 1, size: int = 50,
) -> tuple[DataFrame, DataFrame]:
    order = sort_columns(sort_by, direction, DASHBOARD_SORTS, "total_views", ["page_id", "page_title"])
    total = _on_pages(cards, text).agg(F.count_distinct("page_id").alias("total"))
    return page(dashboard_grid(cards, text), order, number, size), total


def global_stats(cards: DataFrame) -> DataFrame:
    views = F.col("view_count")
    return cards.agg(
        F.count("id").alias("total_cards"),
        F.count_distinct("page_id").alias("total_dashboards"),
        F.coalesce(F.sum(views), F.lit(0)).alias("total_views"),
        F.count_distinct("card_type").alias("total_types"),
        F.count_if((views == 0) | views.isNull()).alias("zero_view_cards"),
    )


def type_distribution(cards: DataFrame) -> DataFrame:
    named = cards.filter(F.col("card_type") != "")
    grouped = count_and_sum(named, ["card_type"], F.col("view_count"), "count", "views")
    return top(grouped, TOP_TYPES, F.desc("count"), F.asc("card_type"))


def top_dashboards(cards: DataFrame) -> DataFrame:
    named = cards.filter(F.col("page_title") != "")
    grouped = count_and_sum(named, ["page_title"], F.col("view_count"), "card_count", "total_views")
    return top(grouped, TOP_DASHBOARDS, F.desc("total_views"), F.asc("page_title"))


def low_usage_cards(
    cards: DataFrame, max_views: int = 10, card_type: str = "", owner: str = ""
) -> DataFrame:
    wanted = [low_usage(F.col("view_count"), max_views), *search({"owner_name": owner}, {})]
    if card_type.strip():
        wanted.append(equals_ci(F.col("card_type"), card_type))
    return where_all(cards, wanted)


def low_usage_page(
    low: DataFrame, limit: int = 100, offset: int = 0
) -> tuple[DataFrame, DataFrame]:
    """A page of the least viewed cards, and their total number."""
    order = [asc("view_count"), asc("title"), asc("id")]
    return window_of_rows(low, order, offset, limit), low.agg(F.count(F.lit(1)).alias("total"))


def _low_by(low: DataFrame, keys: list[str]) -> DataFrame:
    views = F.col("view_count")
    return low.groupBy(*keys).agg(
        F.count("id").alias("card_count"),
        F.coalesce(F.sum(views), F.lit(0)).alias("total_views"),
        F.count_if((views == 0) | views.isNull()).alias("zero_view_count"),
    )


def low_usage_by_owner(low: DataFrame) -> DataFrame:
    return top(_low_by(low, ["owner_name"]), TOP_OWNERS, F.desc("card_count"),
               F.col("owner_name").asc_nulls_last())


def low_usage_by_dashboard(low: DataFrame) -> DataFrame:
    return _low_by(low, ["page_id", "page_title"])


def low_usage_by_type(low: DataFrame) -> DataFrame:
    return _low_by(low, ["card_type"]).drop("zero_view_count")


def low_usage_by_dataset(cards: DataFrame, max_views: int = 10) -> DataFrame:
    """Per data source: cards, low-usage cards and their share in percent."""
    low: Column = low_usage(F.col("view_count"), max_views)
    named = cards.filter(F.col("datasource_id").isNotNull())
    return named.groupBy("datasource_id", "datasource_name").agg(
        F.count("id").alias("total_cards"), F.count_if(low).alias("low_usage_count")
    ).withColumn(
        "low_usage_pct", F.round(F.col("low_usage_count") * 100.0 / F.col("total_cards"), 2)
    )


