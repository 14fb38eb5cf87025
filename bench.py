"""Headline queries on one local session; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from patchloom.plans import QUERIES
from patchloom.session import build_session

HEADLINE = [
    "stage_durations", "job_state_latest", "job_log_concat", "lines_exploded", "line_diff", "lint_lines", "language_detect",
    "chunk_renumber", "chunk_containment", "prompt_containment", "prompt_batches", "prompt_render", "reply_batched_blocks",
    "splice_lines", "retry_waits", "brace_units", "python_units", "structure_compare", "replay_by_function", "property_checks",
    "check_rollup", "run_summary", "zip_members", "stream_stage_state",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(2 * int(cpus)) if cpus.isdigit() else "16",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "exit_statuses", sf_dir)  # start the executors; not counted
    cold, warm = {}, {}
    for name in only or HEADLINE:
        times = [run(spark, name, sf_dir) for _ in range(repeats)]
        cold[name], warm[name] = round(times[0], 3), round(statistics.median(times), 3)
    print(json.dumps({
        "metric": "headline queries, sum of medians", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus, "repeats": repeats, "rows": {"lineitem": spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
