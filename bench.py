"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: data folder; BENCH_CPUS: local cores; BENCH_QUERIES: comma-separated names, or ``all``.
A query is timed once after a warm-up of the session (its first run: cold) and once more (warm, reported). With BENCH_SLOW=1
the model queries are timed too, once each, outside the total.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evidloom.plans.registry import QUERIES  # noqa: E402
from evidloom.session import build_session  # noqa: E402

HEADLINE = [
    "topic_profile", "extractions", "kb_flat", "corpus_from_pages", "topic_coverage", "extract_features", "triage",
    "dialogue_accumulate", "fuzzy_best_match", "kb_lookup_fallback", "relaxed_lookup", "cart_totals", "cart_adjust",
    "orders_listing", "stratified_split", "weighted_metrics",
]
#: fits models or runs a stream: timed once, on request
SLOW = ["rf_predict", "gbt_predict", "reg_predict", "soft_vote", "tree_attribution", "triage_model", "dialogue_triage",
        "stored_recommend", "dialogue_triage_stream"]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    chosen = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE))
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n in QUERIES]
    spark = build_session(cores, "evidloom-bench")
    spark.read.parquet(f"{folder}/region.parquet").count()
    cold, warm = {}, {}
    for name in names:
        cold[name] = run(spark, name, folder)
        warm[name] = run(spark, name, folder)
    slow = {name: run(spark, name, folder) for name in SLOW} if os.environ.get("BENCH_SLOW") == "1" else {}
    print(json.dumps({
        "metric": "total warm seconds of the headline queries", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "slow": slow, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cores": int(cores),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
