"""Every registered query gives the same rows as its SQL, on the smallest tables."""

import oracle
import pytest

from ledgerlens.queries import ORACLE, QUERIES

SMALLEST, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# Their page, or their filters, lie beyond the few rows of the smallest tables.
NEED_LARGER = {
    "q_card_list", "q_dashboards", "q_export_datasets", "q_health_classify", "q_list_datasets",
    "q_optional_filters", "q_probe_candidates", "q_with_card",
}


@pytest.fixture(scope="module")
def connections():
    return {folder: oracle.connect(folder) for folder in (SMALLEST, LARGER)}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, connections, name):
    folder = LARGER if name in NEED_LARGER else SMALLEST
    con = connections[folder]
    difference, n, _ = oracle.compare(spark, con, name, QUERIES[name], ORACLE[name], folder)
    assert difference is None
    assert n > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["m", "month", "current_year", "prev_year", "yoy_ratio"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
