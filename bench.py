"""Headline queries on ``$BENCH_SF_DIR`` with ``$BENCH_CPUS`` cores; prints one JSON line.

Each query runs once on the smallest data to warm up and then ``$BENCH_RUNS`` times (default 2); the median counts. Results
go to a sink that computes every row and keeps none.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import suite  # noqa: E402
from verbatim.session import local_session  # noqa: E402

QUERIES = [
    "pr3_quality_flags",
    "ag1_quality_report",
    "tx6_preprocess_text",
    "cp4_sentiment_columns",
    "jn1_exact_keyword_documents",
    "jn1_exact_keyword_join",
    "cp1_keyword_assignments",
    "cp1_keyword_fuzzy",
    "jn6_fuzzy_documents",
    "cp2_semantic_assignments",
    "rk3_similarity_top_k",
    "cp3_reranked_assignments",
    "cp6_segments",
    "ag7_segment_summary",
    "ag12_word_frequencies_documents",
    "jn12_compare_assignments",
    "jn16_not_near_existing",
    "ag18_enriched_subthemes",
    "cp10_full_job",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = os.environ.get("BENCH_ONLY", "").split()
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    queries = suite.queries()
    seconds: dict[str, float] = {}
    for name in only or QUERIES:
        times = []
        warm = Path(sf_dir).parent / "sf0.01"
        for i in range(runs + 1):
            start = time.perf_counter()
            folder = str(warm) if i == 0 and warm.exists() else sf_dir
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if i > 0:
                times.append(took)
            print(f"{name} {took:.2f}", file=sys.stderr, flush=True)
        seconds[name] = round(statistics.median(times), 3)
    responses = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "responses": responses,
                "answers_per_sec_semantic": round(
                    responses * 3 / seconds["cp2_semantic_assignments"]
                ) if "cp2_semantic_assignments" in seconds else None,
            }
        )
    )


if __name__ == "__main__":
    main()
