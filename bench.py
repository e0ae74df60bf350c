"""Bench: wall seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed through Spark's no-op sink (every row produced,
nothing collected). Each query gets one discarded run, then the median of
$BENCH_REPEATS timed runs is reported.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "score_summary", "score_records", "score_leaves", "gold_manifest", "normalised_fields",
    "doc_profile", "corpus_summary", "gold_name_match", "response_parse", "document_prompts",
    "threshold_sweep", "cascade_routing", "latency_percentiles", "text_chunks", "retrieval_topk",
    "failure_taxonomy",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    discard = os.environ.get("BENCH_DISCARD", "1") == "1"  # one discarded run per query
    from quarry.plans.catalog import QUERIES
    from quarry.session import local_session

    spark = local_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    QUERIES["doc_profile"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    times: dict[str, float] = {}
    for name in HEADLINE:
        if discard:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        runs = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus,
                      "spark": spark.version, "repeats": repeats, "discarded_runs": int(discard)}))


if __name__ == "__main__":
    main()
