"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query wall seconds.

Each query is executed fully with the ``noop`` sink (all rows produced, none
collected).  Timings are steady-state: before timing, every headline query
runs once, untimed, on the smallest scale factor (different, tiny data —
Spark caches no results across queries), so JVM class loading, JIT and
expression compilation are not billed to the first timed query.
Set BENCH_WARMUP=0 to time cold starts instead, and BENCH_QUERIES=all for
every query that has an oracle.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spoofscope.plans.registry import ORACLES, QUERIES, load_all  # noqa: E402
from spoofscope.session import get_session  # noqa: E402

HEADLINE = [
    "window_features", "report_per_file", "tracking_windows",
    "trajectory_features", "trajectory_tail", "state_dedup", "snapshot_explode",
    "threshold_sweep", "roc_auc", "classification_report",
    "track_path", "gps_normalize",
    "iq_stats", "welch_psd",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    load_all()
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    # "all": every query but the model fits
    names = sorted(ORACLES) if only == ["all"] else only or HEADLINE
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.environ.get("BENCH_WARMUP", "1") != "0" and os.path.isdir(warm_dir):
        for q in names:
            QUERIES[q](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for q in names:
        t0 = time.perf_counter()
        QUERIES[q](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[q] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
