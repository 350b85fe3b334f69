"""URL filter: the registered query against its SQL, and small cases of time and specificity."""

import oracle

from ledgerlens.llm import urls
from ledgerlens.llm.queries import ORACLE, QUERIES

SMALLEST = "/root/testdata/sf0.001"


def test_query_agrees_with_sql(spark):
    con = oracle.connect(SMALLEST)
    for name, sql in ORACLE.items():
        difference, n, _ = oracle.compare(spark, con, name, QUERIES[name], sql, SMALLEST)
        assert difference is None and n > 0


def test_intervals_and_specificity(spark):
    entries = spark.createDataFrame([
        ("bad.org", "block", "add", "2024-01-10"), ("bad.org", "block", "add", "2024-01-12"),
        ("bad.org", "block", "remove", "2024-02-01"), ("ok.bad.org", "allow", "add", "2024-01-20"),
        ("Tie.net", "block", "add", "2024-01-01"), ("tie.net", "allow", "add", "2024-01-01"),
        ("day.net", "block", "add", "2024-01-05"), ("day.net", "block", "remove", "2024-01-05"),
        (None, "block", "add", "2024-01-01"), ("x.y", "block", "add", None),
    ], "pattern string, list string, action string, day string")
    captures = spark.createDataFrame([
        (1, "http://bad.org/a", "2024-01-09"), (2, "http://bad.org", "2024-01-10"),
        (3, "https://u@WWW.bad.org:8/x", "2024-01-31"), (4, "http://bad.org/", "2024-02-01"),
        (5, "http://ok.bad.org/", "2024-01-15"), (6, "http://ok.bad.org/", "2024-01-20"),
        (7, "http://notbad.org/", "2024-01-15"), (8, "http://tie.net?q", "2024-01-02"),
        (9, "http://day.net", "2024-01-06"), (10, None, "2024-01-15"), (11, "http://bad.org", None),
        (12, "no url", "2024-01-15"), (2, "http://bad.org", "2024-01-10"),
    ], "id int, url string, day string").selectExpr("id", "url", "day", "id AS url_filter", "id AS host")
    got = urls.judge(captures, entries).collect()
    kept = sorted((r["id"], r["url_filter"]["kept"]) for r in got)
    assert kept == sorted([
        (1, True), (2, False), (2, False), (3, False), (4, True), (5, False), (6, True), (7, True),
        (8, True), (9, True), (10, True), (11, True), (12, True)])
    assert {r["id"]: r["url_filter"]["n_active"] for r in got}[6] == 2
    assert all(r["host"] == r["id"] for r in got)
    assert all(r["url_filter"]["kept"] for r in urls.judge(captures, entries.limit(0)).collect())
    assert urls.judge(captures.limit(0), entries).count() == 0
