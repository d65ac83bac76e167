"""Benchmark: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed end to end from Parquet into the ``noop`` sink (so
the whole plan runs but nothing is collected).  Every query is run
``BENCH_REPEATS`` times after one warm-up run of the flagship; the median is
reported.  Prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEATS (default 3), BENCH_QUERIES (comma list; default all).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from petrograph.plans.registry import load_all  # noqa: E402
from petrograph.session import build_session  # noqa: E402


def run_once(spark, q, sf_dir: str) -> float:
    t0 = time.perf_counter()
    q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = max(1, int(os.environ.get("BENCH_REPEATS", "3")))
    reg = load_all()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(reg)
    spark = build_session(f"local[{cpus}]", app="petrograph-bench", shuffle_partitions=2 * cpus,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    run_once(spark, reg["event_report"], sf_dir)   # warm-up (JIT, file listing cache)
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for n in names:
        try:
            times[n] = round(statistics.median(run_once(spark, reg[n], sf_dir) for _ in range(repeats)), 4)
        except Exception as e:  # noqa: BLE001 - report and continue
            errors[n] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {"metric": "total_median_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": cpus, "repeats": repeats, "n_queries": len(times)}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
