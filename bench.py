"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line.  Every query is executed in
full through the ``noop`` sink, so nothing is collected on the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skillgrid.plans import catalog  # noqa: E402
from skillgrid.session import build_session  # noqa: E402

HEADLINE = [
    "demand_index",
    "role_requirements",
    "cumulative_evidence",
    "monthly_demand_series",
    "trend_slopes",
    "current_snapshots",
    "reject_reasons",
    "dedup_survivors",
    "skill_match_tiers",
    "run_ledger_status",
    "outbox_first_event",
    "skill_gap",
    "roadmap",
    "role_search_tiers",
    "insert_or_get",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    master = f"local[{cpus}]"
    spark = build_session(master, shuffle_partitions=int(cpus) * 2, app_name="skillgrid-bench")
    # warm-up: every headline query once on the smallest tables (JIT and the
    # generated-code cache), so the timed runs measure the work, not compilation
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in names:
        catalog.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()  # plan building may run jobs (materialised intermediates)
        df = catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "master": master,
        "cores": int(cpus),
    }))


if __name__ == "__main__":
    main()
