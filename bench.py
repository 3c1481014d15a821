"""Times the headline queries and prints one line of JSON; some also as plain Python on one thread (twins.py). BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "hybrid_search", "dense_topk", "bm25_or", "bm25_strict_broad", "entity_match_topk", "lexical_relevance", "rank_fusion", "near_dup_penalty", "entity_division", "overlap_join", "before_k",
    "nearest_k", "scd2_facts", "as_of_fact", "neighbors_both", "stale_checkpoints", "temporal_next", "chain_rollup", "cumulative_cost", "sessionize_30m", "tumbling_1h", "rate_report",
    "category_rollup", "trace_percentiles", "token_f1", "hash_embedding", "metrics_by_k", "expand_scored", "merge_entities", "epoch_fold", "window_pack", "virtual_lookup",
)


def main() -> None:
    from mnemospark.plans import registry
    from mnemospark.session import session
    from twins import TWINS

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = session(f"local[{cpus}]", int(cpus) * 2, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").sum("id").collect()  # the JVM's own start isn't a query's
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    alone = {}
    for name in took:
        if name in TWINS:
            began = time.perf_counter()
            TWINS[name](sf_dir)
            alone[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, wall clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "single_thread": alone}))


if __name__ == "__main__":
    main()
