"""Benchmark the headline queries.

Runs each query in ``HEADLINE`` on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` (default 8): one warm-up
pass, then the median of ``$BENCH_REPEAT`` timed runs (default 3).  Each run
executes the full plan into the ``noop`` sink (no driver collect).  Prints one
JSON line: {"metric", "value" (sum of medians), "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "spec_query", "bar_agg", "filter_multi", "describe", "column_profile", "corr_matrix", "histogram_by",
    "box_stats", "top_category", "anomaly_counts", "trend_slope", "formula_set", "geo_lookup_join",
    "ab_t_test", "ab_mann_whitney", "chi_square", "sequential_t", "anova", "ts_decompose", "stream_aggregate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [a for a in sys.argv[1:]]
    from quarry.registry import QUERIES
    from quarry.session import get_spark

    scratch = tempfile.mkdtemp(prefix="quarry-bench-")
    spark = get_spark(f"local[{cpus}]", app="quarry-bench", shuffle_partitions=cpus,
                      extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "8g"),
                             "spark.local.dir": scratch})
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    times = {}
    for name in only or HEADLINE:
        run(name)  # warm-up: JIT, file listing, Python workers
        times[name] = round(statistics.median(run(name) for _ in range(repeat)), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
