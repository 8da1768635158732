"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES
(comma-separated names, default the list below).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from agorasift.plans import load_all
from agorasift.plans.registry import QUERIES
from tests.session import local_session

HEADLINE = (
    # ingest and text
    "scan_ndjson", "expand_embedded", "dedup_first_seen", "keyword_filter", "import_tokens", "tokenize", "ngrams",
    # daily tables
    "unique_users", "user_token_frequency", "token_totals", "retweet_edges", "user_urls", "user_daily_stats",
    "posts_list_per_user",
    # experiment
    "multiplex_edges", "weak_component", "strong_component", "element_ids", "relevant_vocabulary", "dtm_posts",
    "adjacency_retweet",
    # labels and models
    "label_votes", "feature_coo", "log_odds", "classification_report", "classifier_predictions",
    # analysis
    "word_frequencies", "node_components", "anomaly_features", "anomaly_scores", "communities", "topic_matrix",
    "lda_doc_topics", "place_join", "place_terms", "nmf_topics", "emotion_scores", "place_emotion",
    # streaming
    "stream_counts", "stream_edges",
)


def run(spark, name: str, root: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = local_session(cpus)
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark.read.parquet(f"{root}/events.parquet").count()  # start the executor
    times = {}
    for name in names:
        times[name] = round(run(spark, name, root), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
        if len(names) > 1:  # what a stopped run has done so far
            with open(os.path.join(tempfile.gettempdir(), "agorasift-bench-partial.json"), "w") as out:
                json.dump({"metric": "partial_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times}, out)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": root.rstrip("/").split("sf")[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
