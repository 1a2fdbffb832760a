"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run once to warm the session (code generation, Python workers) and then timed.
Results are consumed in full by a ``noop`` write, so nothing is pruned and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loreworks.plans import registry  # noqa: E402
from loreworks.session import build_session  # noqa: E402

HEADLINE = (
    "s15_replace_documents",
    "c13_chunk_documents",
    "c16_incremental_diff",
    "c18_cache_hits",
    "c24_pool_vectors",
    "q02_inverted_index",
    "q03_bm25_topk",
    "q08_knn_topk",
    "q16_hybrid_retrieval",
    "q22_global_search",
    "e06_latency_stats",
    "g01_resolve_links",
    "g02_semantic_edges",
    "g06_components",
    "g11_place_new",
    "l08_timeline_groups",
    "l12_project_tasks",
    "w09_late_rows",
    "p06_briefing_totals",
    "p12_open_tasks",
    "t07_longest_path_rank",
    "m02_fold_facts",
    "m08_match_attempts",
    "r01_redact_text",
    "a03_replay_policy",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        app="bench", master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.log.level": "ERROR",
        },
    )
    queries = registry.queries()
    times: dict[str, float] = {}
    for name in names:
        run = lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        run()
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
