"""Times the headline queries: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pagemill.plans import catalog  # noqa: E402
from pagemill.session import local_session  # noqa: E402

HEADLINE = (
    "bm25_topk", "bm25_dedup_topk", "candidate_rerank", "rrf_fusion", "score_at_k", "score_slices_grouping_sets", "paired_outcomes",
    "sliding_windows", "snippet_window", "dense_topk", "late_interaction", "citation_support", "risk_coverage_curve", "cluster_bootstrap_hash", "call_log_hourly",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, **{"spark.sql.shuffle.partitions": str(max(8, int(cores)))})
    queries = catalog.queries()
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run also compiles
            began = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, best of two", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
