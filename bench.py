"""Benchmark: registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The session is warmed up with a few queries, then each query is timed (the median of BENCH_RUNS, default 1).
BENCH_QUERIES (comma-separated name prefixes) chooses other queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "n01", "n02", "n03", "n04", "n05", "n06", "n07", "n08", "n09", "n10", "n11", "n12", "n13", "n14", "n15", "n16",
    "n17", "n18", "n19", "payer_rules", "wide_to_long", "exact_quantiles", "location_summary", "match_cascade",
    "blocked_candidates", "point_in_zone", "duplicate_content", "normalize_wide_files",
)
WARM_UP = ("n11_comparable_price_mart", "n17_dashboard_insurer_summary", "n02_payer_price_summary")


def main() -> None:
    from ratebook import registry
    from ratebook.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = tuple(filter(None, os.environ.get("BENCH_QUERIES", "").split(","))) or HEADLINE
    spark = local_session(cpus)

    def run(query) -> float:
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in WARM_UP:
        run(registry.queries()[name])
    times = {}
    for name, query in registry.queries().items():
        if not name.startswith(wanted):
            continue
        times[name] = round(statistics.median(run(query) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total warm query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
