"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is forced to completion with a ``noop`` write (every row computed,
nothing collected).  A warm-up query runs first so JVM start-up is not billed
to the first query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "evaluate_regression",
    "evaluate_classification",
    "avg_rank",
    "validate_predictions",
    "best_per_user",
    "leaderboard",
    "user_history",
    "profile_dataset",
    "kfold",
    "stratified_kfold",
    "kmer_counts_documents",
    "normalize_total",
    "ensemble_vote",
    "cross_validate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from scorewell.plans.catalog import load_all
    from scorewell.session import local_session

    n = int(cpus) if cpus.isdigit() else os.cpu_count() or 8
    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * n), app="scorewell-bench")
    queries = load_all()
    only = [q for q in sys.argv[1:] if q in queries]
    names = only or [q for q in HEADLINE if q in queries]

    queries["seq_length"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
