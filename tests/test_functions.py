"""Scalar semantics: casts, dates, formula text, predicates."""

import datetime as dt
import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import casts, formulas, periods, predicates


def values(spark, texts, make, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_try_date(spark):
    day = dt.date(2025, 4, 1)
    good = ["2025-04-01", "2025/4/1", "2025-4-1", " 2025-04-01 ", "2025-04-01 10:00:00"]
    bad = ["2025-04", "2025-13-01", "20250401", "未定", "", None, "2025-04-01x"]
    assert values(spark, good, casts.try_date) == [day] * len(good)
    assert values(spark, bad, casts.try_date) == [None] * len(bad)


def test_try_bigint(spark):
    cases = {"12": 12, "12.7": 13, "12.5": 13, "-12.5": -13, "1e3": 1000, " 12 ": 12, "+5": 5,
             "1,000": None, "": None, "未定": None, "99999999999999999999": None,
             "9223372036854775807": 9223372036854775807}
    assert values(spark, list(cases), casts.try_bigint) == list(cases.values())


def test_joined_skips_null(spark):
    assert values(spark, [None, "x"], lambda c: casts.joined(F.lit("a"), c)) == ["a", "ax"]


def test_parse_year_month(spark):
    texts = ["2024年07月", "202407", "2024/07", "2024年13月", "", None]
    july = dt.date(2024, 7, 1)
    assert values(spark, texts, casts.parse_year_month) == [july, july, july, None, None, None]


def test_epoch_timestamp(spark):
    at = dt.datetime(2020, 9, 13, 12, 26, 40)
    got = values(spark, [1600000000, 1600000000000, 0, None], casts.epoch_timestamp, "bigint")
    assert got == [at, at, None, None]


def test_strip_space_trims_every_space(spark):
    assert values(spark, ["　\n x \t"], casts.strip_space) == ["x"]


@pytest.mark.parametrize("ref, expected", [
    ("2025-05-01", ["請求日未入力", "今期", "前期", "36.0期", "39.0期", "-1.0期"]),
    ("2024-02-01", ["請求日未入力", "38.0期", "37.0期", "今期", "39.0期", "-1.0期"]),
])
def test_period_label(spark, ref, expected):
    days = [None, "2025-06-30", "2024-12-31", "2024-01-01", "2025-07-01", "2005-12-31"]
    got = values(spark, days, lambda c: periods.period_label(c.cast("date"), ref))
    assert got == expected


def test_month_edges_and_labels(spark):
    got = values(spark, ["2024-02-01"], lambda c: F.array(
        periods.month_end(c.cast("date")).cast("string"), periods.month_label(c.cast("date"))))
    assert got == [["2024-02-29", "2月"]]


def test_hours_between_truncates(spark):
    got = values(spark, ["2024-01-01 00:30:00"], lambda c: periods.hours_between(
        c.cast("timestamp"), F.lit("2024-01-03 00:00:00").cast("timestamp")))
    assert got == [47]
    clock = values(spark, ["2024-01-01 00:30:00"], lambda c: periods.clock_text(
        c.cast("timestamp"), "Asia/Tokyo", " JST"))
    assert clock == ["2024-01-01 09:30 JST"]


FORMULA = """/* total
of all */ CASE  WHEN `Price` > 12.50 -- net
THEN 'yes' ELSE "No Name" END + FORMULA_REF(77)"""


def test_formula_forms(spark):
    plain = 'case when price > 12.50 then \'yes\' else "no name" end + formula_ref(77)'
    masked = "case when price > NUM then STR else COL end + BM_REF"
    assert values(spark, [FORMULA], formulas.normalised) == [plain]
    assert values(spark, [plain], formulas.structural) == [masked]
    names = ["duplicate_hash", "normalized_hash", "structure_hash"]
    want = [hashlib.md5(t.encode()).hexdigest()[:12] for t in (FORMULA, plain, masked)]
    df = spark.createDataFrame([(0, FORMULA), (1, " \n"), (2, None)], "i int, v string")
    got = formulas.with_fingerprints(df, "v").orderBy("i").select(*names).collect()
    assert [list(r) for r in got] == [want, [""] * 3, [""] * 3]


def test_complexity_and_references(spark):
    text = "x" * 1000 + FORMULA + " case\n when FORMULA_REF(5)"
    assert values(spark, [text, "", None], formulas.complexity) == [5 + 2 + 2, 0, 0]
    assert values(spark, [text], formulas.referenced_ids) == [[77, 5]]
    other = values(spark, ["A.REF(3) AxREF(4)"], lambda c: formulas.referenced_ids(c, "A.REF"))
    assert other == [[3]]


def test_card_ids_and_lists(spark):
    assert values(spark, ["dr:12:x", "34"], formulas.bare_card_id) == ["12", "34"]
    assert values(spark, ['["a","b"]', "oops", None, "{}"], formulas.json_list) == [["a", "b"], [], [], []]
    ids = '["1","2","3","4","5","6"]'
    assert values(spark, [ids], lambda c: formulas.first_names(formulas.json_list(c))) == ["1, 2, 3, 4, 5"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abAB%_\\ é", max_size=6), min_size=1, max_size=5), st.text(alphabet="ab%_\\", min_size=1, max_size=2))
def test_contains_ci_takes_text_literally(spark, texts, wanted):
    got = values(spark, texts, lambda c: predicates.contains_ci(c, wanted))
    assert got == [wanted.lower() in t.lower() for t in texts]


def test_null_keeping_exclusion(spark):
    got = values(spark, [None, "A保守費", "b"], lambda c: predicates.keep_unless_like(c, "%保守費%", "x%"))
    assert got == [True, False, True]


def test_failure_rules_disagree_where_they_should(spark):
    cases = [("FAILED_DATA", "ok"), ("my error", "ok"), ("", "Error"), (None, "failed"), ("FAILED", "disabled by x"),
             ("FAILED", "DISABLED"), (None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, e string, s string").orderBy("i")
    got = [tuple(r) for r in df.select(
        predicates.failed_by_prefix(F.col("e"), F.col("s")),
        predicates.failed_by_prefix(F.col("e"), F.col("s"), status_may_fail=True),
        predicates.failed_by_word(F.col("e"), F.col("s"))).collect()]
    assert got == [(True, True, True), (False, False, True), (True, True, True), (False, True, True),
                   (False, False, True), (False, False, False), (False, False, False)]


def test_optional_predicates(spark):
    df = spark.createDataFrame([(None,), (3,), (9,)], "n int")
    count = lambda preds: predicates.where_all(df, preds).count()
    n = F.col("n")
    assert count([]) == 3
    assert count(predicates.at_least(n, 0, True)) == 3
    assert count(predicates.at_least(n, 3, False)) == 2
    assert count(predicates.card_count_direction(n, "lt", 5)) == 2
    assert count([predicates.low_usage(n, 3)]) == 2
    assert count(predicates.search({"x": " "}, {"y": ""})) == 3


def test_severity(spark):
    words = ["FAILED_X", "ERROR", "my ERROR", "stale", "ok", None]
    assert values(spark, words, predicates.severity) == [0, 0, 2, 1, 2, 2]
    assert values(spark, words, predicates.severity_exact) == [2, 0, 2, 1, 2, 2]
