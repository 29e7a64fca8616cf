"""Headline-query timing.  Prints one JSON line.

Runs each headline query to completion (``noop`` sink: every row computed, nothing
collected) on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` (default sf0.1); after one
warm-up query, each query runs ``$BENCH_RUNS`` times (default 3) and the best time is
reported.  ``value`` is the sum of the per-query times.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanlake import get_spark  # noqa: E402
from spanlake.plans.catalog import all_queries  # noqa: E402

HEADLINE = [
    "stratified_sample",       # sample build: rollup, buckets, capped per-query draw
    "pass_at_k",               # evaluation: fuzzy match + pass@k for all k in one scan
    "any_match_rate",
    "stitch_windows",          # sliding-window split + stitch
    "compose_twostep",         # two-step block composition
    "twostep_exact_match_rate",
    "exact_match_rate",        # span extraction + exact match
    "vocab_encode",            # token -> id through the vocabulary
    "file_answer_agg",         # per-file answer concatenation
    "render_prompt",           # prompt build: sample x meta x file text x few-shot
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark(f"local[{cpus}]", app="spanlake-bench", shuffle_partitions=int(cpus) * 2,
                      **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    qs = all_queries()
    qs["stratified_sample"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus), "runs": runs,
                      "stat": "min"}))


if __name__ == "__main__":
    main()
