"""Times every registered query and prints one JSON line.

Environment: BENCH_SF_DIR (folder of the tables), BENCH_CPUS (cores),
BENCH_ONLY (comma list of name prefixes, "all" for every query), BENCH_RUNS
(timed runs after a warm-up, median taken; 1 means no warm-up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Queries that drive a stream to its end; they are timed once, without warm-up.
STREAMING = "stream_"

#: One or more queries of every operator family, with the heaviest joins.
HEADLINE = (
    "error_rate_gate", "canary_3sigma", "latency_percentiles", "perf_regression", "gate_matrix", "failure_classes",
    "evaluate_thresholds", "log_slo", "eval_metrics", "flaky_steps", "superseded_runs", "audit_titles",
    "audit_descriptions", "extract_fix_refs", "parse_commands", "scan_secrets", "detect_stack", "propose_branches",
    "extract_flags", "pin_consistency", "find_duplicates", "similar_issues", "dedupe_errors", "correlate_deploys",
    "verify_fixes", "correlate_cves", "flag_lifecycle", "concurrent_deploys", "nearest_ancestor_with",
    "suppress_repeats", "dependency_updates", "maintenance_health", "changelog", "version_bump", "doc_drift",
    "deploy_event_feeds", "normalize_events", "coverage_percent", "audit_workflows", "evaluate_issue_plans",
    "evaluate_pr_plans", "label_state", "extract_plans", "final_text", "render_prompts", "split_due", "observe_sessions",
    "stream_error_rate", "stream_commands",
)


def main() -> None:
    from gatelake import catalog
    from gatelake.catalog.registry import JOBS
    from gatelake.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = tuple(p for p in os.environ.get("BENCH_ONLY", "").split(",") if p)
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    catalog.load()
    spark = local_session(cpus, partitions=int(cpus), memory="12g")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times: dict[str, float] = {}
    for name, job in JOBS.items():
        if not (only == ("all",) or (name.startswith(only) if only else name in HEADLINE)):
            continue
        took = []
        for _ in range(1 if name.startswith(STREAMING) else runs + (runs > 1)):
            start = time.time()
            job(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        times[name] = round(statistics.median(took[1:] or took), 3)
        print(f"{times[name]:8.3f}  {name}", file=sys.stderr, flush=True)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": int(cpus),
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
