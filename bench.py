"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, default the
headline set, ``all`` for every registered query), BENCH_RUNS (default 3), BENCH_SCALING (further folders, comma list).
Each time is the median of BENCH_RUNS full runs of a query into a no-op sink, planning included, after an untimed run of it.
``rows_per_second`` is rows of the input table with the most rows (events or lineitem) by that time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleet_queries import QUERIES  # noqa: E402
from snapcat.session import local_session  # noqa: E402

HEADLINE = (
    "compare_snapshots",
    "compare_stats",
    "filter_regex",
    "filter_ranks",
    "filter_rank_chain",
    "plan_select",
    "delete_plan",
    "delete_except",
    "latest_common",
    "replication_actions",
    "incremental_steps_long",
    "step_sizes",
    "minmax_series",
    "monitor_alerts",
    "due_series",
    "round_up_fixed",
    "round_up_month",
    "tree_roots",
    "tree_deletable",
    "state_merge",
    "policy_expand",
    "job_summary",
    "log_bytes",
    "log_deltas",
    "log_rate",
    "trial_summary",
)


def timed(spark, name: str, sf_dir: str, runs: int) -> float:
    times = []
    for k in range(runs + 1):  # the first one warms up
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - started)
    return round(statistics.median(times[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    runs = max(1, int(os.environ.get("BENCH_RUNS", "3")))
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "snapcat-bench")
    spark.sparkContext.setLogLevel("ERROR")
    scaling = {}
    for folder in [*filter(None, os.environ.get("BENCH_SCALING", "").split(",")), sf_dir]:
        count = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("events", "lineitem")}
        found = {}
        for name in names:
            found[name] = timed(spark, name, folder, runs)
            print(f"{os.path.basename(folder)} {name}: {found[name]}", file=sys.stderr, flush=True)
        rows = {n: round(count["lineitem" if n == "trial_summary" else "events"] / t) for n, t in found.items()}
        scaling[os.path.basename(os.path.normpath(folder))] = round(sum(found.values()), 3)
    total = round(sum(found.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    out = {"metric": "headline_total", "value": total, "unit": "sec", "queries": found, "sf": sf}
    print(json.dumps(out | {"rows_per_second": rows, "totals": scaling}))


if __name__ == "__main__":
    main()
