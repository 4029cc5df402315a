"""Bench: wall time of the headline queries on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is run to completion into the no-op sink (every row computed,
nothing collected).  One warm-up query runs first; ``BENCH_REPEATS`` (default
1) timed runs per query, the median is reported.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tsdrift.plans import catalog  # noqa: E402
from tsdrift.session import local_session  # noqa: E402

HEADLINE = (
    "resample_mean", "interpolate_linear", "feature_table", "psi", "ks_multi", "drift_monitor",
    "backtest", "run_summary", "compare_policies", "drift_validation",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else list(HEADLINE)
    spark = local_session(cores=cpus, shuffle_partitions=cpus)
    run(catalog.QUERIES["resample_mean"](spark, sf_dir))  # warm-up
    times = {}
    for name in names:
        samples = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            run(catalog.QUERIES[name](spark, sf_dir))
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
