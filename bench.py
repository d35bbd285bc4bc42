"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
cores. Each query is run to the end without collecting its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "top100_earning",
    "earning_concentration",
    "customer_details",
    "club_status_stats",
    "sold_qty_quantiles",
    "enrich_left",
    "warm_filter_counts",
    "article_features",
    "customer_features",
    "transaction_features",
    "dictionaries",
    "encoded_train",
    "label_probs",
    "uniform_negatives",
    "popularity_negatives",
    "training_set",
    "content_user_vectors",
    "retrieve_topk",
    "retrieve_threshold",
    "offline_candidates",
    "candidates_filtered",
    "rank_frame",
    "reranked_feed_linear",
    "recall_at_k",
    "sampled_softmax_loss",
    "pr_auc",
    "tfidf_weights",
    "text_search",
    "vector_search",
    "knn_catalog",
    "feed_page",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")

    from vitrine.plans import QUERIES
    from vitrine.session import local_session

    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf}/part.parquet").count()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
