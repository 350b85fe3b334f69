"""Card usage queries: parts stand for cards, brand and type for dashboards and owners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.plans import usage
from ledgerlens.operators.merging import ARRIVAL
from ledgerlens.queries.registry import Tables, query

CARDS = """(SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_type AS card_type,
    CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size < 5 THEN 0 ELSE p_size END AS view_count,
    nullif(p_brand, 'Brand#3') AS owner_name, CASE WHEN p_size <> 7 THEN p_size END AS page_id,
    CASE WHEN p_type = 'SMALL' THEN '' ELSE p_type || ' ' || (p_size % 4) END AS page_title,
    nullif(p_brand, 'Brand#9') AS datasource_id FROM part)"""


def cards(t: Tables) -> DataFrame:
    size, brand = F.col("p_size"), F.col("p_brand")
    return t.part.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"),
        F.col("p_type").alias("card_type"),
        F.when(size % 10 == 0, None).when(size < 5, 0).otherwise(size).alias("view_count"),
        F.nullif(brand, F.lit("Brand#3")).alias("owner_name"),
        F.when(size != 7, size).alias("page_id"),
        F.when(F.col("p_type") == "SMALL", "").otherwise(
            F.concat("p_type", F.lit(" "), (size % 4).cast("string"))).alias("page_title"),
        F.lit(None).cast("timestamp").alias("last_viewed_at"),
        F.nullif(brand, F.lit("Brand#9")).alias("datasource_id"),
        F.nullif(brand, F.lit("Brand#9")).alias("datasource_name"))


@query("q_card_list", f"""
    SELECT id, title, view_count FROM {CARDS} c WHERE lower(title) LIKE '%ring%' AND lower(card_type) = 'promo'
        AND lower(owner_name) LIKE '%brand%' ORDER BY title ASC NULLS LAST, id LIMIT 20 OFFSET 20
""")
def card_list(t: Tables) -> DataFrame:
    rows, _ = usage.card_list(
        cards(t), text="Ring", card_type="promo", owner="BRAND", sort_by="title", direction="asc",
        number=2, size=20)
    return rows.select("id", "title", "view_count")


@query("q_global_stats", f"""
    SELECT count(*) AS total_cards, count(DISTINCT page_id) AS total_dashboards,
        CAST(coalesce(sum(view_count), 0) AS BIGINT) AS total_views, count(DISTINCT card_type) AS total_types,
        count(*) FILTER (view_count = 0 OR view_count IS NULL) AS zero_view_cards FROM {CARDS} c
""")
def global_stats(t: Tables) -> DataFrame:
    return usage.global_stats(cards(t))


@query("q_type_distribution", f"""
    SELECT card_type, count(*) AS "count", CAST(coalesce(sum(view_count), 0) AS BIGINT) AS views FROM {CARDS} c
    WHERE card_type <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
""")
def type_distribution(t: Tables) -> DataFrame:
    return usage.type_distribution(cards(t))


@query("q_top_dashboards", f"""
    SELECT page_title, count(*) AS card_count, CAST(coalesce(sum(view_count), 0) AS BIGINT) AS total_views FROM {CARDS} c
    WHERE page_title <> '' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10
""")
def top_dashboards(t: Tables) -> DataFrame:
    return usage.top_dashboards(cards(t))


@query("q_dashboards", f"""
    SELECT page_id, page_title, count(*) AS card_count, CAST(coalesce(sum(view_count), 0) AS BIGINT) AS total_views,
        (SELECT count(DISTINCT page_id) FROM {CARDS} c WHERE page_title <> '' AND lower(page_title) LIKE '%o%') AS total
    FROM {CARDS} c WHERE page_id IS NOT NULL AND page_title <> '' AND lower(page_title) LIKE '%o%'
    GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50 OFFSET 50
""")
def dashboards(t: Tables) -> DataFrame:
    rows, total = usage.dashboards(cards(t), "O", sort_by="card_count", number=2, size=50)
    return rows.withColumn("total", total.scalar())


@query("q_low_usage", f"""
    SELECT id, title, view_count, count(*) OVER () AS total FROM {CARDS} c WHERE view_count <= 10 OR view_count IS NULL
    ORDER BY view_count ASC NULLS FIRST, title, id LIMIT 100 OFFSET 10
""")
def low_usage(t: Tables) -> DataFrame:
    low = usage.low_usage_cards(cards(t), 10)
    rows, total = usage.low_usage_page(low, 100, 10)
    return rows.select("id", "title", "view_count", total.scalar().alias("total"))


LOW = f"(SELECT * FROM {CARDS} c WHERE view_count <= 10 OR view_count IS NULL)"
LOW_SUMS = """count(*) AS card_count, CAST(coalesce(sum(view_count), 0) AS BIGINT) AS total_views,
    count(*) FILTER (view_count = 0 OR view_count IS NULL) AS zero_view_count"""


@query("q_owner_rollup", f"""
    SELECT owner_name, {LOW_SUMS} FROM {LOW} c GROUP BY 1 ORDER BY 2 DESC, 1 ASC NULLS LAST LIMIT 20
""")
def owner_rollup(t: Tables) -> DataFrame:
    return usage.low_usage_by_owner(usage.low_usage_cards(cards(t)))


@query("q_low_usage_by_dashboard", f"SELECT page_id, page_title, {LOW_SUMS} FROM {LOW} c GROUP BY 1, 2")
def low_by_dashboard(t: Tables) -> DataFrame:
    return usage.low_usage_by_dashboard(usage.low_usage_cards(cards(t)))


@query("q_low_usage_by_type", f"""
    SELECT card_type, count(*) AS card_count, CAST(coalesce(sum(view_count), 0) AS BIGINT) AS total_views
    FROM {LOW} c WHERE lower(owner_name) LIKE '%#1%' GROUP BY 1
""")
def low_by_type(t: Tables) -> DataFrame:
    return usage.low_usage_by_type(usage.low_usage_cards(cards(t), owner="#1"))


@query("q_low_usage_by_group", f"""
    SELECT datasource_id, datasource_id AS datasource_name, count(*) AS total_cards,
        count(*) FILTER (view_count <= 10 OR view_count IS NULL) AS low_usage_count,
        round(count(*) FILTER (view_count <= 10 OR view_count IS NULL) * 100.0 / count(*), 2) AS low_usage_pct
    FROM {CARDS} c WHERE datasource_id IS NOT NULL GROUP BY 1
""")
def low_by_dataset(t: Tables) -> DataFrame:
    out = usage.low_usage_by_dataset(cards(t), 10)
    return out.withColumn("low_usage_pct", F.col("low_usage_pct").cast("double"))


@query("q_refresh_views", f"""
    SELECT c.id, CASE WHEN o.o_orderkey IS NULL THEN c.view_count
            WHEN o_orderpriority = '5-LOW' THEN 0 ELSE o_custkey END AS view_count,
        CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS last_seen,
        CASE WHEN o.o_orderkey IS NULL THEN c.datasource_id WHEN o_orderstatus = 'O' THEN o_orderpriority END AS datasource_id
    FROM {CARDS} c LEFT JOIN orders o
        ON c.id = CASE o_orderpriority WHEN '1-URGENT' THEN 'gone' ELSE '' END || CAST(o_orderkey AS VARCHAR)
""")
def refresh_views(t: Tables) -> DataFrame:
    o, status = t.orders, F.col("o_orderstatus")
    # Urgent orders bring records of cards that are not there.
    gone = F.when(F.col("o_orderpriority") == "1-URGENT", "gone").otherwise("")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    source = F.struct(F.col("o_orderpriority").alias("dataSourceId"), status.alias("dataSourceName"))
    empty = F.array().cast("array<struct<dataSourceId:string,dataSourceName:string>>")
    info = o.select(
        F.concat(gone, F.col("o_orderkey").cast("string")).alias("id"),
        F.struct(
            F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("totalViewCount"),
            F.when(status != "P", ms).otherwise(0).alias("lastViewedDate")).alias("viewInfo"),
        F.when(status == "O", F.array(source)).otherwise(empty).alias("datasources"),
        F.lit(2).alias(ARRIVAL))
    # An earlier record of each card with more views, a later date and a greater source.
    more = F.struct(F.lit(10 ** 9).alias("totalViewCount"), F.lit(4 * 10 ** 12).alias("lastViewedDate"))
    info = info.unionByName(info.withColumns({
        "viewInfo": more.cast(info.schema["viewInfo"].dataType),
        "datasources": F.array(F.struct(F.lit("zz").alias("dataSourceId"), F.lit("zz").alias("dataSourceName"))),
        ARRIVAL: F.lit(1)}))
    base = cards(t).withColumn("view_count", F.col("view_count").cast("bigint"))
    return usage.refresh_view_counts(base, info).select(
        "id", "view_count", F.date_format("last_viewed_at", "yyyy-MM-dd").alias("last_seen"),
        "datasource_id")
