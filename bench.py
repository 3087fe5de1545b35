"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import re
import time

from cairnflow.queries import QUERIES
from cairnflow.session import build_session

NAMES = ["audit_discrepancies", "audit_report", "cost_by_agent", "cost_summary_period", "compliance_report", "fairness_report", "chain_verify", "temperature_alerts", "alerts_throttled", "latest_state", "sparse_topk", "dense_topk", "hybrid_rrf", "retrieval_metrics", "clause_integrity", "pii_flags", "chunk_fixed", "semantic_cache_lookup", "heading", "chain_build", "lineage_join", "token_df_idf", "first_alerts", "provider_benchmark", "bootstrap_ci", "quality_gate"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in NAMES:
        run(name)
        began = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - began, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "total seconds of headline queries, second run", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
