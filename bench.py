"""Benchmark: headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the `noop` sink (nothing is
collected to the driver).  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from linewise.plans.catalog import registered  # noqa: E402
from linewise.session import build_session  # noqa: E402

HEADLINE = [
    "projects_overview",      # full scan: metrics + rules + guards + duplicates + scores
    "file_metrics",
    "apply_rules",
    "line_class",
    "duplicate_groups",
    "technology_inventory",
    "license_summary",
    "quality_gate",
    "source_preview",
    "history_ring",
    "sessionize",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus))
    qs = registered()
    names = [n for n in HEADLINE if n in qs]
    # warm-up: JVM, parquet footers, Python workers
    qs["detect_language"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
