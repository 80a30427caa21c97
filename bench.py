"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from edgeloom.plans.catalog import QUERIES  # noqa: E402
from edgeloom.session import local_session  # noqa: E402

HEADLINE = (
    "relation_weights", "gate_rows", "score_total", "edge_severity", "path_modules", "reach_dependencies", "cycles_through_nodes", "dag_layers",
    "cycle_components", "ready_tasks", "document_findings", "line_findings", "line_clones", "scenario_lint", "commit_inventory", "parsed_commits",
    "evidence_conclusions", "evidence_posterior", "plan_drift", "manifest_drift", "conflict_tiers", "file_overlap", "event_routes", "idempotent_runs",
    "state_transitions", "gate_retries", "discussion_convergence", "issue_dependencies", "stream_gate_retries",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    line = {"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
