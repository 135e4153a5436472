"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "a9_cohort_matrix", "a11_cost_weighted", "a16_calibration_summary", "a17_latency_summary", "a19_cluster_bootstrap",
    "a20_fit_temperature", "j3_change_window", "j4_incident_correlation", "l1_rubric_label", "a29_group_components",
    "a28_leak_check", "v14_row_rules", "w4_stratified_split", "a30_template_mining", "p13_deidentify_text",
    "w2_thread_cap", "j10_passages_in_text", "j11_bm25_nearest", "d6_ranking", "t2_alert_burden",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)

    from alertloom.plans import registry
    from alertloom.session import local_session

    spark = local_session(cores, "alertloom-bench")
    queries = registry.queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    took: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times), 3)
        print(f"{name}: {took[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
