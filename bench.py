"""Time the registered queries and print one JSON line.

``BENCH_SF_DIR`` is the folder of parquet tables (default: /root/testdata/sf0.1), ``BENCH_CPUS``
the number of local cores. Every query is planned, run and written to a sink that drops the
rows; the time of a query is the better of two runs, planning included.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conformance.queries import QUERIES  # noqa: E402
from evalspark.session import local_session  # noqa: E402

HEADLINE = (
    "messages_hashes",
    "execution_ids",
    "missing_executions",
    "glob_double_star",
    "upsert_tasks",
    "upsert_runs",
    "summary_by_model",
    "summary_by_model_filtered",
    "summary_by_task",
    "runs_display",
    "export_rows",
    "pending_grades",
    "apply_grades",
    "prune_runs",
    "orphan_report",
    "resolve_models",
    "validate_contains",
    "parse_prompts",
    "discover_tasks",
    "task_tree",
)
REPEATS = 2


def measure(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    times = {}
    for name in HEADLINE:
        times[name] = round(min(measure(spark, name, folder) for _ in range(REPEATS)), 3)
    spark.stop()
    result = {
        "metric": "total time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
