"""Benchmark the headline queries.

Runs each query over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line. Each query is executed to
completion through the ``noop`` sink (full plan, no driver collection); the
reported time is the best of ``$BENCH_REPEAT`` runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerfold.plans import catalog  # noqa: E402
from ledgerfold.session import build_session  # noqa: E402

HEADLINE = [
    "overrun_rate_by_category",
    "label_history",
    "label_baseline_ultimate",
    "mod_reasons",
    "numeric_profile",
    "correlation_pairs",
    "topic_tokens",
    "tfidf_sql",
    "bag_of_words",
    "cosine_topk",
    "stratified_folds",
    "roc_auc_rank",
    "link_best",
    "light_clean",
    "label_runs_agreement",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    names = [n for n in (sys.argv[1:] or HEADLINE)]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus * 2, 8),
                          extra={"spark.driver.memory": "16g"})
    qs = catalog.queries()
    times = {}
    for n in names:
        if n not in qs:
            continue
        best = None
        for i in range(repeat + 1):
            t0 = time.time()
            qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.time() - t0
            if i > 0 or repeat == 0:
                best = dt if best is None else min(best, dt)
        times[n] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
