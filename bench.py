"""Time the headline queries; prints one JSON line. Each query: one warm-up, then the median."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.queries import QUERIES  # noqa: E402
from ledgerlens.session import build_session  # noqa: E402

HEADLINE = [
    "q_yoy", "q_revenue_pivot", "q_summary", "q_profile", "q_filter_values", "q_page", "q_page_deep",
    "q_expand_months", "q_expand_months_seq", "q_running_sum", "q_running_sum_ranged",
    "q_running_sum_2key", "q_global_row_number", "q_unpivot_pairs", "q_nullsafe_join",
    "q_child_count", "q_upsert", "q_latest_per_key", "q_cost_routing", "q_fingerprints",
    "q_duplicates_structural", "q_classify_usage", "q_export_labels", "q_dashboards",
    "q_low_usage", "q_health_classify", "q_auto_check", "q_propagate_status", "q_nested_records",
    "q_final_output",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "ledgerlens-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        took = []
        for _ in range(runs + 1):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
            spark.catalog.clearCache()  # a later run must not read what an earlier one kept
        seconds[name] = round(statistics.median(took[1:] or took), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "sum of median query times", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
