"""Times headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma list, default the headline ones, ``all`` for every query).
"""

from __future__ import annotations

import json
import os
import sys
import time

from rowloom.catalog import QUERIES
from rowloom.session import local_session

HEADLINE = [
    "cells_long", "edge_list", "edge_list_tokens", "numeric_adjacency", "dict_codes", "compressed_edges",
    "adjacency", "transition_probability", "uniform_slots", "weighted_slots",
    "walks_uniform", "walks_weighted", "walks_no_backtrack", "walks_hidden_nodes", "walks_remainder",
    "knn_cosine", "knn_l2", "knn_pruned", "knn_approximate", "cross_source_candidates", "er_report", "prf", "eq_report",
    "kendall_per_key", "similarity_list", "similarity_merge", "word2vec", "cbow", "subword", "pca", "train_and_match",
    "count_sliding", "time_sliding", "stream_edges", "stream_windows", "stream_er", "tripartite_graph",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/part.parquet").count()  # start the engine before the clock
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
