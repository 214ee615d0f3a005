"""Headline queries, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and threads."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

QUERIES = (
    "migration_pairs", "pair_shares", "removal_stats", "cohort_counts", "reverse_dependents", "asof_backward", "islands", "running_intervals", "dependents_over_time", "semver_resolution", "weekly_rebucket", "outages",
    "exact_neighbours", "change_set", "pricing_summary", "quantiles", "first_of_group", "serve_version_share",
)


def main() -> None:
    from marlstone.plans import registry
    from marlstone.session import session

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    queries, took = registry.queries(), {}
    spark.read.parquet(f"{folder}/nation.parquet").count()
    for name in QUERIES:
        began = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
