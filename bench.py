"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated names, or "all").
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "flagship_popularity_eval", "min_interactions_filter", "attach_counts", "phase_domain_summary", "time_decay_popularity",
    "normalized_adjacency", "history_window", "test_targets", "cap_per_user", "user_sequences", "chunk_sequences",
    "leave_last_out", "dense_ids", "negative_sample", "average_rank", "build_examples", "render_item_id_dialogue",
    "token_truncate", "batch_embed", "knn_l2", "catalog_score", "resolve_collisions", "constrained_beam",
    "e_ndcg_recall_mrr", "evaluate_all", "h_gauc", "h_auc", "h_gini", "eval_title", "eval_sem_id",
    "average_merge", "extrapolate_linear", "ties_merge", "mask_magnitude", "mask_merge",
    "eval_sem_id_distance", "render_chat_example", "hard_negative_filter", "union_examples", "aux_variants",
]


def main() -> None:
    from recquarry.plans import registry
    from recquarry.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(registry.QUERIES) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    # warm the JVM and the Python workers outside the measured part
    for name in ("min_interactions_filter", "leave_last_out", "resolve_collisions", "knn_l2"):
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    out = {
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
