"""Benchmark the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]:
one warm-up run, then three timed runs executed to completion with the ``noop``
sink (full computation, no collection); reports the median per query and the sum.
Prints ONE JSON line.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "flagship_monthly_category_spend",
    "E1_build_all_features",
    "E2_engineer_features",
    "C11_clean_transactions",
    "W6_count_7d_ledger",
    "G2_G4_monthly_stats",
    "M20_fit_per_category",
    "R1_forecast_report",
    "T4_top3_per_row",
    "M16_M17_detect_anomalies",
    "U3_apply_updates",
    "J4_users_left_transactions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from kassa.plans.registry import load_all
    from kassa.session import build_session

    spark = build_session(master=f"local[{cpus}]", app="kassa-bench", shuffle_partitions=int(cpus),
                          extra={"spark.driver.memory": os.environ.get("KASSA_DRIVER_MEMORY", "8g")})
    reg = load_all()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    out = {}
    for name in names:
        q = reg[name]
        q.run(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
        times = []
        for _ in range(runs):
            spark.catalog.clearCache()   # no cached intermediates carried between runs
            t0 = time.perf_counter()
            q.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "sum_median_query_seconds", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf_dir,
                      "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
