"""The revenue report: eight inputs to one 55-column table, as a single lazy plan.

issues, Excel tasks, monthly fees and subscriptions become one task list; the list is bucketed into
half-year periods with running totals, unpivoted by assignee, and united with budget and history.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.casts import (
    date_from_parts, has_digits, joined, parse_year_month, try_bigint, try_date,
)
from ledgerlens.functions.periods import (
    MONTH_SUFFIX, as_date, month_end, month_start, period_label, year_month_text,
)
from ledgerlens.functions.predicates import (
    all_of, keep_unless_like, on_or_after_or_undated, one_of,
)
from ledgerlens.operators.aggregates import child_counts
from ledgerlens.operators.merging import HOT_ROWS, lookup
from ledgerlens.operators.ordering import RANGE_ROWS, asc, global_row_number, running_sums
from ledgerlens.operators.reshape import expand_months, unpivot_numbered, unpivot_pairs
from ledgerlens.session import broadcast_if_small, pin
from ledgerlens.sources.sinks import StepCounts, write_csv
from ledgerlens.sources.store import Store

# ---- Fixed values: words, codes and column names that make up the report's contract. ----
PROJECT_ID = 1073851282
PROJECT_NAME = "PTJ加盟店サイト関連"
HISTORY_TASK_ID = 999999999
HISTORY_TITLE = "過去粗利データ"
STATUS_DONE = "完了"
BILLED_STATUSES = ("完了", "請求済", "定期更新")
FEE_WEIGHT = 10
ISSUE_TYPE_PATTERN = r"^\d{4}／"
PRODUCT_CODES = {4034: "4034／WEB広告クリエイティブ", 3267: "3267／加盟店用WEB保守月額"}
SUBSCRIPTION_PRODUCT = "サブスクLP_月額費用"
SUBSCRIPTION_CODE = "5917／サブクスLP"
EXCEL_DROPPED = ("%保守費%", "%チャットボット月額%")
CATEGORY_TASKS = "課題リスト"
CATEGORY_WEIGHTS = "ウェイト別課題"
CATEGORY_BUDGET = "予算"
CHILD, PARENT = "子課題", "親課題"
MONTH_PART = "月分)"
ASSIGNEES = [f"担当者{n}" for n in "①②③④⑤⑥⑦⑧⑨"]
WEIGHT_PAIRS = [(a, f"{a}のウェイト") for a in ASSIGNEES]

# Common task columns: business name -> (type, field of issues and Excel tasks).
TASK_FIELDS: dict[str, tuple[str, str]] = {
    "プロジェクトID": ("bigint", "projectId"),
    "親課題ID": ("bigint", "parentIssueId"),
    "課題ID": ("bigint", "id"),
    "ステータスID": ("string", "status_id"),
    "ステータス名": ("string", "status_name"),
    "課題タイトル": ("string", "summary"),
    "タスクの担当者名": ("string", "assignee_name"),
    "加盟店名": ("string", "customFields0_value"),
    "開始日": ("date", "startDate"),
    "期限日": ("date", "dueDate"),
    "税抜費用": ("string", "customFields2_value"),
    "担当者①": ("string", "customFields6_value_name"),
    "担当者①のウェイト": ("bigint", "customFields7_value"),
    "担当者②": ("string", "customFields8_value_name"),
    "担当者②のウェイト": ("bigint", "customFields9_value"),
    "課題URL": ("string", "課題URL"),
    "担当者③": ("string", "customFields10_value_name"),
    "担当者③のウェイト": ("bigint", "customFields11_value"),
    "担当者④": ("string", "customFields12_value_name"),
    "担当者④のウェイト": ("bigint", "customFields13_value"),
    "担当者⑤": ("string", "customFields14_value_name"),
    "担当者⑤のウェイト": ("bigint", "customFields15_value"),
    "請求日": ("date", "customFields5_value"),
    "税抜外注費用": ("bigint", "customFields3_value"),
    "ERAWANコード": ("string", "issueType_name"),
    "課題の登録日": ("date", "created"),
    "担当者⑥": ("string", "担当者６"),
    "担当者⑥のウェイト": ("bigint", "担当者６ウェイト"),
    "担当者⑦": ("string", "担当者７"),
    "担当者⑦のウェイト": ("bigint", "担当者７ウェイト"),
    "担当者⑧": ("string", "担当者８"),
    "担当者⑧のウェイト": ("bigint", "担当者８ウェイト"),
    "担当者⑨": ("string", "担当者９"),
    "担当者⑨のウェイト": ("bigint", "担当者９ウェイト"),
    "AP加盟店ID": ("string", "customFields1_value"),
    "登録者": ("string", "createdUser_name"),
}
# Fields the Excel sheet does not have, and its second assignee's weight, which it keeps elsewhere.
EXCEL_ABSENT = {"parentIssueId", "status_id", "assignee_name", "created", "createdUser_name",
                "customFields1_value", "customFields3_value", "customFields8_value_name"}
EXCEL_MOVED = {"customFields9_value": "customFields8_value"}

# The 55 output columns in order.
OUTPUT_SCHEMA: list[tuple[str, str]] = [
    ("プロジェクト名", "string"), ("プロジェクトID", "bigint"), ("親課題ID", "bigint"),
    ("課題ID", "bigint"), ("ステータスID", "string"), ("ステータス名", "string"),
    ("課題タイトル", "string"), ("タスクの担当者名", "string"), ("加盟店名", "string"),
    ("開始日", "date"), ("期限日", "date"), ("税抜費用", "string"),
    ("担当者①", "string"), ("担当者①のウェイト", "bigint"),
    ("担当者②", "string"), ("担当者②のウェイト", "bigint"), ("課題URL", "string"),
    ("担当者③", "string"), ("担当者③のウェイト", "bigint"),
    ("担当者④", "string"), ("担当者④のウェイト", "bigint"),
    ("担当者⑤", "string"), ("担当者⑤のウェイト", "bigint"),
    ("請求日", "date"), ("税抜外注費用", "bigint"), ("ERAWANコード", "string"),
    ("課題の登録日", "date"), ("担当者⑨のウェイト", "bigint"),
    ("担当者⑧", "string"), ("担当者⑧のウェイト", "bigint"), ("担当者⑨", "string"),
    ("担当者⑦のウェイト", "bigint"), ("担当者⑦", "string"),
    ("担当者⑥のウェイト", "bigint"), ("担当者⑥", "string"),
    ("AP加盟店ID", "string"), ("登録者", "string"), ("親/子課題", "string"),
    ("請求日（期）", "string"), ("税抜費用（int）", "bigint"),
    ("累計売上額（見込み）", "bigint"), ("累計売上額（実績）", "bigint"),
    ("BLカテゴリ", "string"), ("請求年", "bigint"), ("担当者種別", "string"),
    ("担当者", "string"), ("種", "string"), ("ウェイト", "bigint"), ("カテゴリ", "string"),
    ("請求月", "bigint"), ("売上予算額", "bigint"), ("累計売上予算額", "bigint"),
    ("年", "string"), ("月", "bigint"), ("子課題数", "bigint"),
]

_ISSUE_COLUMNS = [f for _, f in TASK_FIELDS.values() if not f.startswith(("担当者", "課題"))]
_EXCEL_COLUMNS = sorted(
    ({f for _, f in TASK_FIELDS.values()} - EXCEL_ABSENT - set(EXCEL_MOVED))
    | set(EXCEL_MOVED.values())
)
INPUT_COLUMNS: dict[str, list[str]] = {
    "issues": [*_ISSUE_COLUMNS, "issueKey"],
    "projects": ["id", "projectKey", "name"],
    "excel_tasks": _EXCEL_COLUMNS,
    "monthly_fees": ["商品名", "加盟店名", "ERAWAN", "単価（円/税抜）", "開始年月", "終了年月"],
    "subscriptions": ["加盟店名", "単価（円/税抜）", "請求開始年月", "終了年月"],
    "calendar": ["calendar_year", "calendar_month", "calendar_date"],
    "budget": ["year", "category", *[str(m) for m in range(1, 13)]],
    "history": ["_COLUMN_1", *[f"{m}月" for m in range(1, 13)]],
}
# ---- End of fixed values. ----


@dataclass(frozen=True)
class RevenueConfig:
    """Dates, the project of interest, and how issue links look."""

    project_id: int = PROJECT_ID
    project_name: str = PROJECT_NAME
    issue_floor: dt.date = dt.date(2025, 4, 1)
    fee_floor: dt.date = dt.date(2025, 1, 1)
    history_ceiling: dt.date = dt.date(2024, 12, 31)
    calendar_first_year: int = 2024
    link_base: str = "https://tracker.example/view/"
    range_rows: int = RANGE_ROWS
    hot_rows: int = HOT_ROWS


def issue_link(key: Column, base: str) -> Column:
    return joined(F.lit(f'<a href="{base}'), key, F.lit('" target="_blank">'), key, F.lit("</a>"))


def _typed(text: Column, kind: str) -> Column:
    return {"bigint": try_bigint, "date": try_date}.get(kind, lambda c: c.cast("string"))(text)


def _conform(df: DataFrame, present: Mapping[str, Column]) -> DataFrame:
    """Select the common task columns; what a source lacks is a typed NULL."""
    return df.select(*[
        (present[name] if name in present else F.lit(None)).cast(kind).alias(name)
        for name, (kind, _) in TASK_FIELDS.items()
    ])


def branch_issues(issues: DataFrame, cfg: RevenueConfig) -> DataFrame:
    """Coded issues billed from the floor date on, or not dated yet."""
    coded = issues.filter(F.col("issueType_name").rlike(ISSUE_TYPE_PATTERN))
    linked = coded.withColumn("課題URL", issue_link(F.col("issueKey"), cfg.link_base))
    billing = try_date(F.col("customFields5_value"))
    kept = linked.filter(on_or_after_or_undated(billing, cfg.issue_floor))
    return _conform(kept, {
        name: _typed(F.col(f), kind)
        for name, (kind, f) in TASK_FIELDS.items() if not f.startswith("担当者")
    })


def branch_excel(excel: DataFrame) -> DataFrame:
    """Imported tasks without the maintenance and chatbot fees, which arrive by subscription."""
    kept = excel.filter(keep_unless_like(F.col("summary"), *EXCEL_DROPPED))
    return _conform(kept, {
        name: _typed(F.col(EXCEL_MOVED.get(f, f)), kind)
        for name, (kind, f) in TASK_FIELDS.items() if f not in EXCEL_ABSENT
    })


def calendar_months(calendar: DataFrame, first_year: int) -> DataFrame:
    """Month starts from the first year on."""
    months = calendar.filter(
        (F.col("calendar_year").try_cast("int") >= first_year)
        & (F.col("calendar_date").cast("string") == "01")
    )
    date = date_from_parts(F.col("calendar_year"), F.col("calendar_month"), F.col("calendar_date"))
    return months.select(
        F.col("calendar_year").try_cast("int").alias("calendar_year"),
        F.col("calendar_month"),
        date.alias("calendar_date"),
        F.col("calendar_month").try_cast("int").alias("calendar_month_int"),
        year_month_text(F.col("calendar_year"), F.col("calendar_month")).alias("year_month"),
    )


def product_code(code: Column) -> Column:
    """Known product numbers as labels, any other as text."""
    labels = F.create_map(*[F.lit(x) for kv in PRODUCT_CODES.items() for x in kv])
    return F.coalesce(labels[code.try_cast("int")], code.cast("string"))


def _spans(fees: DataFrame, kind: str, start: str, product: Column, code: Column) -> DataFrame:
    return fees.filter(has_digits(F.col(start))).select(
        F.lit(kind).alias("kind"),
        product.alias("product"),
        F.col("加盟店名").alias("shop"),
        code.alias("code"),
        F.col("`単価（円/税抜）`").cast("string").alias("price"),
        parse_year_month(F.col(start)).alias("from_month"),
        parse_year_month(F.col("終了年月")).alias("to_month"),
    )


def fee_spans(fees: DataFrame) -> DataFrame:
    named = fees.filter(F.col("商品名").isNotNull())
    return _spans(named, "fee", "開始年月", F.col("商品名"), product_code(F.col("ERAWAN")))


def subscription_spans(subs: DataFrame) -> DataFrame:
    product, code = F.lit(SUBSCRIPTION_PRODUCT), F.lit(SUBSCRIPTION_CODE)
    return _spans(subs, "subscription", "請求開始年月", product, code)


def branch_recurring(
    spans: DataFrame, months: DataFrame, ref_date: dt.date, cfg: RevenueConfig
) -> DataFrame:
    """One task per fee or subscription and calendar month; open spans end in ref_date's month.

    Tasks are numbered per kind in (month, title) order before the date floor; the further order
    columns only settle ties.
    """
    end = F.coalesce("to_month", month_start(F.lit(ref_date).cast("date")))
    rows = expand_months(
        spans, F.col("from_month"), end, months.select("calendar_date", "calendar_month_int"),
        "calendar_date",
    )
    month = F.lpad(F.col("calendar_month_int").cast("string"), 2, "0")
    titled = rows.withColumn("title", joined(F.col("product"), F.lit("("), month, F.lit(MONTH_PART)))
    order = [asc(c, True) for c in ("calendar_date", "title", "shop", "code", "price")]
    numbered = global_row_number(titled, order, "id", restart="kind", range_rows=cfg.range_rows)
    kept = numbered.filter(F.col("calendar_date") >= F.lit(cfg.fee_floor).cast("date"))
    return _conform(kept, {
        "プロジェクトID": F.lit(cfg.project_id),
        "課題ID": F.col("id"),
        "ステータス名": F.lit(STATUS_DONE),
        "課題タイトル": F.col("title"),
        "加盟店名": F.col("shop"),
        "開始日": F.col("calendar_date"),
        "期限日": month_end(F.col("calendar_date")),
        "税抜費用": F.col("price"),
        "担当者①のウェイト": F.lit(FEE_WEIGHT),
        "請求日": F.col("calendar_date"),
        "ERAWANコード": F.col("code"),
    })


def conform_union(branches: list[DataFrame], projects: DataFrame, cfg: RevenueConfig) -> DataFrame:
    """Tasks of the one project, with its name.

    The filter on the project runs inside each branch. Joining on that constant would send every
    task to one partition, so the few project rows left are broadcast when counted to be few.
    """
    union = branches[0]
    for b in branches[1:]:
        union = union.unionByName(b)
    tasks = union.filter(F.col("プロジェクトID") == cfg.project_id)
    names = projects.select(
        try_bigint(F.col("id")).alias("__pid"), F.col("name").alias("プロジェクト名")
    ).filter(F.col("__pid") == cfg.project_id)
    return tasks.join(
        broadcast_if_small(names), F.col("プロジェクトID") == F.col("__pid"), "left"
    ).drop("__pid")


def route_cost(cost: Column) -> Column:
    """Digit-only cost as a number; text, blank and NULL costs have none."""
    clean = F.replace(F.coalesce(cost, F.lit("")), F.lit(","), F.lit(""))
    return F.when(clean.rlike(r"^[0-9]+\z"), clean.try_cast("bigint"))


def post_process(tasks: DataFrame, ref_date: dt.date) -> DataFrame:
    return tasks.withColumns({
        "親/子課題": F.when(F.col("親課題ID").isNotNull(), CHILD).otherwise(PARENT),
        "請求日（期）": period_label(F.col("請求日"), ref_date),
        "税抜費用（int）": route_cost(F.col("税抜費用")),
        "請求年": F.year("請求日").cast("bigint"),
    })


def cumulative_sales(
    tasks: DataFrame, cfg: RevenueConfig, sized_by: DataFrame | None = None
) -> DataFrame:
    """Forecast and actual running totals per period.

    Both share one sort, whose result is pinned. The actual total is looked up by (date, id,
    title), so tasks equal in all three pair up with each other, as the report has always done;
    only they are joined, any other task has its own total.
    """
    cost = F.col("税抜費用（int）")
    billed = one_of(F.col("ステータス名"), BILLED_STATUSES, F.col("請求日"))
    order = [asc(c, True) for c in ("請求日", "課題ID", "課題タイトル", "税抜費用", "ステータス名")]
    sums = {"累計売上額（見込み）": cost, "__actual": F.when(billed, cost)}
    both = pin(running_sums(
        tasks, sums, ["請求日（期）"], order, cfg.range_rows, sized_by))
    keys = ["請求日", "課題ID", "課題タイトル"]
    named = [F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]
    names = [f"__{i}" for i in range(len(keys))]
    same = all_of(F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names))
    repeated = both.groupBy(*named).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    marked = both.join(repeated, same, "left").drop(*names)
    out = "累計売上額（実績）"
    single = marked.filter("__n IS NULL").withColumn(out, F.when(billed, F.col("__actual")))
    several = marked.filter("__n IS NOT NULL")
    actual = several.filter(billed).select(*named, F.col("__actual").alias(out))
    paired = several.join(actual, same, "left").drop(*names)
    return single.unionByName(paired).drop("__actual", "__n")


def weight_rows(tasks: DataFrame) -> DataFrame:
    """Nine rows per task, one per assignee slot, empty slots included."""
    return unpivot_pairs(tasks, WEIGHT_PAIRS, "担当者種別", "担当者", "種", "ウェイト")


def budget_cumulative(budget: DataFrame, ref_date: dt.date, cfg: RevenueConfig) -> DataFrame:
    months = [str(m) for m in range(1, 13)]
    typed = budget.select(
        F.col("year").try_cast("int").alias("__year"),
        F.col("category").alias("カテゴリ"),
        *[try_bigint(F.col(f"`{m}`")).alias(m) for m in months],
    )
    rows = unpivot_numbered(typed, months, "請求月", "売上予算額").withColumn(
        "請求日", date_from_parts(F.col("__year"), F.col("請求月"), F.lit("01"))
    )
    dated = rows.withColumn("請求日（期）", period_label(F.col("請求日"), ref_date))
    order = [asc("請求日", True), asc("売上予算額", True)]
    summed = running_sums(
        dated, {"累計売上予算額": F.col("売上予算額")}, ["請求日（期）", "カテゴリ"], order,
        cfg.range_rows,
    )
    return summed.withColumnRenamed("__year", "請求年")


def history_monthly(history: DataFrame, cfg: RevenueConfig) -> DataFrame:
    months = [f"{m}{MONTH_SUFFIX}" for m in range(1, 13)]
    typed = history.select(
        F.col("_COLUMN_1").cast("string").alias("年"),
        *[try_bigint(F.col(f"`{m}`")).alias(m) for m in months],
    )
    rows = unpivot_numbered(typed, months, "月", "税抜費用（int）").withColumn(
        "請求日", date_from_parts(F.col("年"), F.col("月"), F.lit("01"))
    )
    return rows.filter(F.col("請求日") <= F.lit(cfg.history_ceiling).cast("date")).withColumns({
        "請求年": F.year("請求日").cast("bigint"),
        "プロジェクト名": F.lit(cfg.project_name),
        "プロジェクトID": F.lit(cfg.project_id),
        "課題ID": F.lit(HISTORY_TASK_ID),
        "ステータス名": F.lit(STATUS_DONE),
        "課題タイトル": F.lit(HISTORY_TITLE),
        "税抜外注費用": F.lit(0),
    })


def conform_output(df: DataFrame, category: str) -> DataFrame:
    df = df.withColumn("BLカテゴリ", F.lit(category))
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in OUTPUT_SCHEMA
    ])


def task_list(
    sources: Mapping[str, DataFrame], ref_date: dt.date, cfg: RevenueConfig
) -> DataFrame:
    """All tasks of the project with period, cost and parent flag."""
    months = calendar_months(sources["calendar"], cfg.calendar_first_year)
    spans = fee_spans(sources["monthly_fees"]).unionByName(
        subscription_spans(sources["subscriptions"]))
    branches = [
        branch_issues(sources["issues"], cfg),
        branch_excel(sources["excel_tasks"]),
        branch_recurring(spans, months, ref_date, cfg),
    ]
    return post_process(conform_union(branches, sources["projects"], cfg), ref_date)


def final_output(
    sources: Mapping[str, DataFrame],
    ref_date: dt.date | str,
    cfg: RevenueConfig | None = None,
    counts: StepCounts | None = None,
) -> DataFrame:
    """The 55-column report.

    The task list feeds four branches, so it is pinned once. Child counts are joined to the tasks
    before the nine-fold unpivot, and budget rows, which have no task id, are never joined.
    """
    cfg = cfg or RevenueConfig()
    ref_date = as_date(ref_date)
    watch = counts.watch if counts else (lambda _, df: df)
    tasks = pin(watch("task_list", task_list(sources, ref_date, cfg)))
    children = child_counts(tasks, "親課題ID", "課題ID", "子課題数").withColumnRenamed(
        "親課題ID", "__parent"
    )
    with_children = lookup(tasks, children, "課題ID", "__parent", cfg.hot_rows)
    # All history rows carry one id: one number for all of them, not a join on a constant.
    of_history = children.filter(F.col("__parent") == HISTORY_TASK_ID).select("子課題数").scalar()
    history = history_monthly(sources["history"], cfg).withColumn("子課題数", of_history)
    branches = {
        "cumulative_sales": (cumulative_sales(with_children, cfg, tasks), CATEGORY_TASKS),
        "weight_rows": (weight_rows(with_children), CATEGORY_WEIGHTS),
        "budget": (budget_cumulative(sources["budget"], ref_date, cfg), CATEGORY_BUDGET),
        "history": (history, CATEGORY_TASKS),
    }
    out = None
    for step, (df, category) in branches.items():
        shaped = watch(step, conform_output(df, category))
        out = shaped if out is None else out.unionByName(shaped)
    return out


def run_report(
    sources: Mapping[str, DataFrame],
    ref_date: dt.date | str,
    table_path: str,
    csv_path: str | None = None,
    cfg: RevenueConfig | None = None,
) -> dict[str, int]:
    """Build the report, publish it as the stored table's next version (and CSV), and return rows per step.

    A run that fails leaves the last report whole.
    """
    spark = next(iter(sources.values())).sparkSession
    counts = StepCounts()
    out = counts.watch("final_output", final_output(sources, ref_date, cfg, counts))
    Store(spark, table_path).publish({"report": out}, partition_by={"report": ["BLカテゴリ"]})
    if csv_path:
        write_csv(read_report(spark, table_path), csv_path)
    return counts.result()


def read_report(spark: SparkSession, table_path: str) -> DataFrame | None:
    """The stored report in its column order, or None before the first run.

    The table is partitioned by category, which nearly every card filters on.
    """
    stored = Store(spark, table_path).read("report")
    return None if stored is None else stored.select(*[f"`{c}`" for c, _ in OUTPUT_SCHEMA])
