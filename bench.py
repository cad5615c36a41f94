"""Times the headline queries: one warm-up, then the median of the timed runs. Prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS and BENCH_QUERIES (comma separated) override the defaults.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from leasemill import registry
from leasemill.session import local_session

HEADLINE = [
    "staging_lease",
    "dim_suite",
    "fact_expense",
    "prop_kpi",
    "building_kpi",
    "building_kpi_by_property",
    "noi_monthly",
    "kpi_windows",
    "scd2_lease",
    "scd2_by_property",
    "upsert_by_key",
    "quality_summary",
    "r04_vacant_suites",
    "r07_revenue_by_building",
    "r08_kpi_summary",
    "tenant_suite_count",
    "forecast_wide",
    "forecast_by_property",
    "numeric_coerce",
    "landing_path_parse",
    "staging_ledger",
    "staging_expenses",
    "dim_tenant",
    "fact_rent",
    "kpi_windows_literal",
    "latest_snapshot",
    "quality_failures",
    "r01_property_overview",
    "grid_ledger",
    "grid_lease",
    "as_of_month_detect",
    "quality_model_tests",
    "stream_ingest_equals_batch",
    "scd2_incremental",
    "forecast_selected",
    "reconcile_by_digest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, "leasemill-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 4)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
