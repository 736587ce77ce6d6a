"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the local threads. Every query runs once
to warm up and then ``BENCH_RUNS`` times; the median counts. Results go to the no-op sink, so
that all rows are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks import QUERIES
from driftline.session import build_session

HEADLINE = [
    "w1_latest_revision", "s1_s4_orbit_quantities", "j1_history_of_ids", "j2_rule_join", "o6_chunks",
    "su4_unpivot", "a1_grouped_history", "a6_threshold", "a9_pooled_price_bounds", "s9_clip_per_object",
    "j5_grid_coverage", "a10_cluster_mean", "a10_cluster_mean_all_objects", "w4_keplerian_residual",
    "w5_j2_residual", "w6_lowess", "w8_local_maxima", "w9_distance_suppression", "w11_kalman_filter",
    "detect_keplerian_unsmoothed", "detect_keplerian", "detect_j2", "j3_compare_methods",
    "io3_typed_rows", "acquire_selected_history",
]


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session("driftline-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.log.level": "ERROR"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total of median warm query times", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": base.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
