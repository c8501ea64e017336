"""Time the headline queries; every result row is produced (noop sink).

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores,
``BENCH_RUNS`` the warm runs per query (the median counts), ``BENCH_QUERIES``
restricts the list.  After ``BENCH_SECONDS`` every further query gets one warm
run; models are trained once, without a run to warm up.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "tokens", "sentences", "vocabulary", "bow", "truncate_words", "mark_modifiers", "compound",
    "aspects_present", "aspect_sentiment", "context_sentiment", "sarcasm", "entropy", "unigram_lm",
    "bigram_lm", "aspect_pmi", "information_metrics", "encode", "aspect_mask", "pad_batch", "label_job",
    "prompt_dataset", "prompt_batch_aspects", "parse_response", "reason_three_hop", "evaluate",
    "report_score", "aspect_opinion_pairs", "annotation_lists", "reduce_embeddings",
    "similar_words", "topics",
)
MODELS = ("similar_words", "topics")


def main() -> None:
    from registry import QUERIES
    from sentiloom.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    budget = float(os.environ.get("BENCH_SECONDS", "300"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session("sentiloom-bench", os.environ.get("BENCH_CPUS", str(os.cpu_count())))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/documents.parquet").selectExpr("sum(length(text))").collect()

    seconds, began = {}, time.perf_counter()
    for name in names:
        taken = []
        warm = runs if time.perf_counter() - began < budget else 1
        for _ in range(1 if name in MODELS else warm + 1):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
    total = round(sum(seconds.values()), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of medians", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
