"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default: all)
BENCH_QUERIES  comma-separated names, or "all" (default: the headline set)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigilframe import plans  # noqa: E402
from vigilframe.plans.registry import REGISTRY  # noqa: E402
from vigilframe.session import local_session  # noqa: E402

HEADLINE = [
    "telemetry_screening", "sanitize_texts", "normalized_records", "asset_enrichment", "extracted_iocs", "published_indicators",
    "indicator_matches", "exact_cache_hits", "nearest_vectors", "three_way_routing", "raw_flow_features", "training_features",
    "fused_signals", "behaviour_embeddings", "running_baselines", "rate_violations", "sliding_sequences", "hash_chains",
    "chain_verification", "response_decisions", "density_scores", "percentile_thresholds", "correction_consensus", "upserted_decisions",
    "incident_statistics", "yearly_trend", "policy_violations", "graph_attention", "next_hops", "blast_radius", "blast_radius_best_path", "reachable_nodes", "merged_edges", "retrieved_documents", "node_classifier", "streaming_counters",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    plans.load_all()
    picked = os.environ.get("BENCH_QUERIES", "")
    names = sorted(REGISTRY) if picked == "all" else [n for n in picked.split(",") if n] or HEADLINE
    spark = local_session(cpus, "vigilframe-bench")
    tables = ("events", "lineitem", "documents", "embeddings", "orders", "part")
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in tables}
    REGISTRY["telemetry_screening"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "rows": rows,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
