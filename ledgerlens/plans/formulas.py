"""Formula-catalog analysis: usage groups, duplicates, complexity, clean-up ranking, exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.formulas import (
    DEFAULT_REF_TOKEN, bare_card_id, complexity, first_names, json_list, referenced_ids,
    with_fingerprints,
)
from ledgerlens.functions.predicates import contains_ci
from ledgerlens.operators.merging import lookup
from ledgerlens.operators.ordering import Order, asc, desc, sorts, top, window_of_rows
from ledgerlens.operators.reshape import edges, exploded_links, link_ids
from ledgerlens.session import pin

# ---- Fixed values: group labels, export headers, list lengths. ----
LABELS = {
    "vi": {1: "Không sử dụng", 2: "Từng được dùng", 3: "Card ít xem", 4: "Đang hoạt động"},
    "ja": {1: "未使用", 2: "過去使用", 3: "低閲覧", 4: "稼働中"},
}
HEADERS = {
    "ja": {
        "bm_id": "BM ID", "bm_name": "BM名", "legacy_id": "Legacy ID",
        "group_number": "グループ番号", "group_label": "グループラベル", "owner_name": "オーナー",
        "active_cards_count": "使用カード数", "total_views": "合計閲覧数",
        "referenced_by_count": "参照数", "dataset_names": "データセット名",
        "card_ids": "リンクカード", "complexity_score": "複雑度スコア",
        "duplicate_hash": "重複ハッシュ", "normalized_hash": "正規化ハッシュ",
        "structure_hash": "構造ハッシュ", "url": "URL",
    },
    "vi": {
        "bm_id": "BM ID", "bm_name": "Tên Beast Mode", "legacy_id": "Legacy ID",
        "group_number": "Nhóm số", "group_label": "Nhãn nhóm", "owner_name": "Người tạo",
        "active_cards_count": "Số Card đang dùng", "total_views": "Tổng lượt xem",
        "referenced_by_count": "Số BM tham chiếu", "dataset_names": "Tên Dataset",
        "card_ids": "Link tới Card", "complexity_score": "Độ phức tạp",
        "duplicate_hash": "Mã Hash Trùng Lặp", "normalized_hash": "Mã Hash Chuẩn Hóa",
        "structure_hash": "Mã Hash Cấu Trúc", "url": "Đường dẫn",
    },
}
LOW_VIEW_THRESHOLD = 10
MAX_DUPLICATE_GROUPS = 100
MAX_DATASETS = 20
SUMMARY_DUPLICATES = 20
SUMMARY_DATASETS = 10
# ---- End of fixed values. ----


# ---- Tables from landed payloads ----

def formula_table(search: DataFrame) -> DataFrame:
    return search.select(
        F.col("id"), F.col("name"), F.col("owner").alias("owner_id"),
        F.to_json(link_ids(F.col("links"), "DATA_SOURCE")).alias("datasources"),
    )


def card_map(search: DataFrame) -> DataFrame:
    links = exploded_links(search, ["id"], "links", "CARD")
    return links.select(
        F.col("id").alias("bm_id"), F.col("resource_id").alias("card_id")
    ).distinct().withColumn("is_active", F.lit(True))


def formula_details(detail: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return detail.select(
        "id", blank("expression").alias("expression"), blank("legacyId").alias("legacy_id"),
        F.to_json(F.coalesce("columnPositions", F.array().cast("array<string>")))
        .alias("column_positions"),
    )


def dependency_map(formulas: DataFrame, ref_token: str = DEFAULT_REF_TOKEN) -> DataFrame:
    refs = referenced_ids(F.col("expression"), ref_token)
    return edges(formulas, "id", refs, "bm_id", "depends_on_bm_id")


def missing_expressions(formulas: DataFrame) -> DataFrame:
    """Formulas whose text must be fetched again."""
    return formulas.filter(F.col("expression").isNull() | (F.col("expression") == "")).select("id")


# ---- Analysis ----

def active_links(cards_of: DataFrame) -> DataFrame:
    """(bm_id, card_id) once for each link that is active in any of its rows.

    A link may have several rows. Only active ones are exchanged, whatever the number of the others.
    """
    return cards_of.filter("is_active").select("bm_id", "card_id").distinct()


def usage_facts(formulas: DataFrame, cards_of: DataFrame, deps: DataFrame, cards: DataFrame) -> DataFrame:
    """Formulas with active card count, summed views and how many formulas refer to them."""
    views = cards.select(F.col("id").alias("__card"), "view_count")
    # The rows of repeated links count as well for the sizes, so these need no exchange of links.
    viewed = lookup(
        active_links(cards_of), views, "card_id", "__card", sized_by=cards_of.filter("is_active"))
    per_formula = viewed.groupBy("bm_id").agg(
        F.count(F.lit(1)).alias("__cards"),
        F.sum(F.coalesce("view_count", F.lit(0))).alias("__views"),
    )
    in_degree = deps.groupBy(F.col("depends_on_bm_id").alias("bm_id")).agg(
        F.count(F.lit(1)).alias("__refs")
    )
    keyed = formulas.withColumnRenamed("id", "bm_id")
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t)
    return (
        keyed.join(per_formula, "bm_id", "left").join(in_degree, "bm_id", "left")
        .withColumns({
            "active_cards_count": zero("__cards", "int"),
            "total_views": zero("__views", "bigint"),
            "referenced_by_count": zero("__refs", "int"),
        })
        .drop("__cards", "__views", "__refs")
    )


def usage_group(cards: Column, refs: Column, views: Column, threshold: int) -> Column:
    """1 unused, 2 once used, 3 low views, 4 active; referenced formulas without cards are active."""
    idle = (cards == 0) & (refs == 0)
    return (
        F.when(idle & (views == 0), 1).when(idle & (views > 0), 2)
        .when((cards > 0) & (views <= threshold), 3).otherwise(4)
    )


def labelled(group: Column, lang: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LABELS[lang].items() for x in kv])
    return table[group]


def classify_usage(
    formulas: DataFrame,
    cards_of: DataFrame,
    deps: DataFrame,
    cards: DataFrame,
    owners: DataFrame | None = None,
    threshold: int = LOW_VIEW_THRESHOLD,
    ref_token: str = DEFAULT_REF_TOKEN,
    url_base: str = "",
    lang: str = "vi",
    of_text: bool = True,
) -> DataFrame:
    """The analysis table: one row per formula. Its card ids are in `card_lists`.

    Without of_text the columns made from the formula's text are left out and no text is read: the
    step that digests texts once is one the optimizer keeps, also where nothing uses the digests.
    """
    made = [
        complexity(F.col("expression"), ref_token).alias("complexity_score"),
        *map(F.col, ("duplicate_hash", "normalized_hash", "structure_hash")),
    ] if of_text else []
    # The text is read and digested before any join, so that only digests are shuffled.
    read = with_fingerprints(formulas, "expression", ref_token) if of_text else formulas
    described = read.select(
        "id", "owner_id",
        first_names(json_list(F.col("datasources"))).alias("dataset_names"),
        *made,
        F.coalesce("legacy_id", F.lit("")).alias("legacy_id"),
    )
    facts = usage_facts(described, cards_of, deps, cards)
    if owners is None:
        named = facts.withColumn("owner_name", F.lit(""))
    else:
        known = owners.select(F.col("id").alias("__owner"), F.col("name").alias("owner_name"))
        # The facts hold each formula once, so owners are counted in the formulas.
        named = lookup(facts, known, "owner_id", "__owner", sized_by=formulas)
    group = usage_group(
        F.col("active_cards_count"), F.col("referenced_by_count"), F.col("total_views"), threshold
    )
    return named.select(
        "bm_id",
        group.alias("group_number"),
        labelled(group, lang).alias("group_label"),
        "active_cards_count", "total_views", "referenced_by_count", "dataset_names",
        F.lit("").alias("naming_flag"),
        *[c for c in described.columns if c == "complexity_score" or c.endswith("_hash")],
        F.concat(F.lit(url_base), F.col("bm_id").cast("string")).alias("url"),
        "legacy_id",
        F.coalesce("owner_name", F.lit("")).alias("owner_name"),
    )


def card_lists(cards_of: DataFrame) -> DataFrame:
    """(formula, active card) rows; a list of any length, as no group is gathered anywhere."""
    return active_links(cards_of).select("bm_id", bare_card_id(F.col("card_id")).alias("card_id"))


def duplicate_keys(df: DataFrame, key: str, k: int = MAX_DUPLICATE_GROUPS) -> DataFrame:
    """The k most repeated non-blank values, most frequent first."""
    counted = df.filter(F.col(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))
    return top(counted.filter(F.col("cnt") > 1), k, F.desc("cnt"), F.col(key).asc())


def duplicate_members(
    df: DataFrame, key: str, id_col: str = "bm_id", k: int = MAX_DUPLICATE_GROUPS
) -> DataFrame:
    """(value, count, id) rows of the k largest duplicate groups; no group is gathered anywhere.

    Values are counted and then listed, so they are made once and pinned with their ids. The kept
    values are at most k rows, so they are broadcast and the pinned rows are read in place.
    """
    made = pin(df.select(key, id_col).filter(F.col(key) != ""))
    keys = F.broadcast(duplicate_keys(made, key, k))
    return made.join(keys, key).select(key, "cnt", id_col)


def with_names(analysis: DataFrame, formulas: DataFrame) -> DataFrame:
    names = formulas.select(F.col("id").alias("bm_id"), F.col("name").alias("bm_name"))
    return analysis.join(names, "bm_id")


def duplicate_names(analysis: DataFrame, formulas: DataFrame, k: int = MAX_DUPLICATE_GROUPS) -> DataFrame:
    """(name, count, formula) rows of the k most repeated names."""
    return duplicate_members(with_names(analysis, formulas), "bm_name", "bm_id", k)


def dataset_cleanup_ranking(analysis: DataFrame, url_base: str = "", k: int = MAX_DATASETS) -> DataFrame:
    """Datasets with most unused formulas, and how many are clean-up candidates."""
    grouped = analysis.filter(F.col("dataset_names") != "").groupBy("dataset_names").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("group_number") == 1).alias("unused"),
        F.count_if(F.col("group_number").isin(1, 2, 3)).alias("cleanup_candidates"),
    )
    dataset = F.trim(F.split(F.trim("dataset_names"), ",")[0])
    return top(grouped, k, F.desc("unused"), F.asc("dataset_names")).select(
        dataset.alias("dataset_id"),
        F.when(dataset == "", "").otherwise(F.concat(F.lit(url_base), dataset)).alias("url"),
        "total", "unused", "cleanup_candidates",
    )


def group_counts(analysis: DataFrame) -> DataFrame:
    return analysis.groupBy("group_number", "group_label").agg(
        F.count(F.lit(1)).alias("count")
    ).orderBy("group_number")


def catalog_summary(analysis: DataFrame, formulas: DataFrame) -> dict[str, DataFrame]:
    """Sections of the summary; duplicates are the repeated values with their numbers.

    The analysis is made once, for all sections, and pinned.
    """
    n = SUMMARY_DUPLICATES
    analysis = pin(analysis.select(
        "bm_id", "group_number", "group_label", "duplicate_hash", "normalized_hash",
        "structure_hash", "dataset_names"))
    return {
        "groups": group_counts(analysis),
        "duplicates_exact": duplicate_keys(analysis, "duplicate_hash", n),
        "duplicates_normalized": duplicate_keys(analysis, "normalized_hash", n),
        "duplicates_structure": duplicate_keys(analysis, "structure_hash", n),
        "duplicates_names": duplicate_keys(with_names(analysis, formulas), "bm_name", n),
        "top_dirty_datasets": dataset_cleanup_ranking(analysis, k=SUMMARY_DATASETS),
    }


# ---- Listing, search, export ----

def _by_views() -> list[Order]:
    return [desc("total_views"), asc("bm_id")]


def group_listing(
    analysis: DataFrame, formulas: DataFrame, group: int, limit: int = 100, offset: int = 0
) -> DataFrame:
    hits = with_names(analysis.filter(F.col("group_number") == group), formulas)
    return window_of_rows(hits, _by_views(), offset, limit)


def search_formulas(analysis: DataFrame, formulas: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Digits search the id, anything else the name; a blank search finds nothing.

    Digits of other scripts and numbers beyond 64 bits name no id, so they search the name.
    """
    text = text.strip()
    if text.isascii() and text.isdecimal() and int(text) < 1 << 63:
        hit = F.col("bm_id") == int(text)
    else:
        hit = contains_ci(F.col("bm_name"), text) if text else F.lit(False)
    return top(with_names(analysis, formulas).filter(hit), limit, *sorts(_by_views()))


def with_card(analysis: DataFrame, cards_of: DataFrame, text: str) -> DataFrame:
    """Formulas shown on an active card whose id contains the text."""
    hits = cards_of.filter(F.col("is_active") & bare_card_id(F.col("card_id")).contains(text.strip()))
    return analysis.join(hits.select("bm_id").distinct(), "bm_id", "left_semi")


def export_catalog(
    analysis: DataFrame, formulas: DataFrame, cards_of: DataFrame, lang: str = "vi",
    group: int = 0, card_url_base: str = "",
) -> DataFrame:
    """Rows for the CSV export with translated headers and labels, one per formula and linked card.

    A formula without an active card has one row.
    """
    rows = analysis if group <= 0 else analysis.filter(F.col("group_number") == group)
    prefix = lambda x: F.concat(F.lit(card_url_base), x)
    lists = card_lists(cards_of).select("bm_id", prefix(F.col("card_id")).alias("card_ids"))
    named = with_names(rows, formulas).join(lists, "bm_id", "left")
    labels = labelled(F.col("group_number"), lang)
    full = named.withColumns({
        "group_label": F.coalesce(labels, F.col("group_label")),
        "card_ids": F.coalesce("card_ids", F.lit("")),
    }).orderBy("group_number", *sorts(_by_views()), "card_ids")
    return full.select(*[F.col(k).alias(v) for k, v in HEADERS[lang].items()])


# ---- Removing a formula from card definitions ----

def prune_formula(definitions: DataFrame, legacy_id: str) -> DataFrame:
    """Drop one formula and every reference to it; removed_count says how many formulas went."""
    formulas = F.coalesce("formulas", F.array().cast(definitions.schema["formulas"].dataType))
    kept = F.filter(formulas, lambda f: ~f["id"].eqNullSafe(F.lit(legacy_id)))
    clean = lambda refs: F.filter(
        refs, lambda r: ~r["formulaId"].eqNullSafe(F.lit(legacy_id))
    )
    subscriptions = F.transform_values(
        "subscriptions",
        lambda _, s: F.struct(
            clean(s["columns"]).alias("columns"),
            clean(s["orderBy"]).alias("orderBy"),
            clean(s["groupBy"]).alias("groupBy"),
        ),
    )
    return definitions.withColumns({
        "removed_count": F.size(formulas) - F.size(kept),
        "formulas": kept,
        "subscriptions": subscriptions,
    })


def main_subscription(subscriptions: Column) -> Column:
    """The subscription called "main", else the first one."""
    return F.coalesce(subscriptions["main"], F.map_values(subscriptions)[0])


def catalog_tables(
    search: DataFrame, detail: DataFrame, ref_token: str = DEFAULT_REF_TOKEN
) -> Mapping[str, DataFrame]:
    """Every catalog table of a full refresh, dependency edges included."""
    details = formula_details(detail)
    formulas = formula_table(search).join(details, "id", "left")
    return {
        "formulas": formulas,
        "card_map": card_map(search),
        "dependency_map": dependency_map(formulas, ref_token),
    }


