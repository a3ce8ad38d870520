"""Benchmark: headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from codelode.plans import load_catalogue
from codelode.session import local_session

HEADLINE = [
    "tokenize", "query_terms", "semantic_topk", "lexical_topk", "symbol_exact", "symbol_fuzzy", "contained_symbols",
    "normalize_scores", "merge_signals", "overlap_dedupe", "adjacent_merge", "rank_order", "structural_expand",
    "hybrid_search", "evidence_dedupe", "context_budget", "evidence_quality", "citation_check", "citation_summary",
    "build_context", "chunk_documents", "split_large_chunks", "extract_symbols", "extract_edges", "resolve_edges",
    "chunk_table", "hash_embedding", "find_references", "forward_neighbors", "flow_trace", "impact_references",
    "snapshot_diff", "symbol_remap", "edge_carry_forward", "memory_invalidate", "memory_search", "classify_task",
    "run_trace", "model_comparison", "corpus_inventory", "narration_audit", "cache_upsert", "stream_call_pairing",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    queries = load_catalogue().queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start executors before timing
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
