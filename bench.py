"""Headline queries on local cores; prints one JSON line.

Every query runs once to warm up, then BENCH_RUNS times (default 1); the median counts.
BENCH_SF_DIR, BENCH_CPUS and BENCH_ONLY (comma-separated keys) adjust a run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "evac_summary", "cohort", "radius_of_gyration", "displacement_curve", "home_area", "interaction_edges",
    "edges_by_threshold", "local_clustering", "support_ratio", "econ_connectedness", "location_rank", "stay_duration",
    "kde_fixed", "exact_quantiles", "hist2d", "point_in_polygon", "nearest_area", "ols_hc1", "wls_hc3", "group_shares",
    "od_excess", "tie_distance_own", "incremental_daily",
]


def main() -> None:
    from areaflow.catalog import registry
    from areaflow.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = [k for k in os.environ.get("BENCH_ONLY", "").split(",") if k]
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}
    for key in only or HEADLINE:
        taken = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i > 0:
                taken.append(time.perf_counter() - t0)
        seconds[key] = round(statistics.median(taken), 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cores": cores}))


if __name__ == "__main__":
    main()
