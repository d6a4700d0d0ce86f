"""Time the headline queries. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Shared intermediate tables are forgotten before every query, so each one pays for
all of its own work.
"""

from __future__ import annotations

import json
import os
import sys
import time

from srcloom import registry, staging
from srcloom.session import local_session

HEADLINE = [
    "redact_text",
    "declaration_scan",
    "inventory",
    "project_stats",
    "resolve_dependencies",
    "traverse_bidirectional",
    "plan_query",
    "verify_answers",
    "repair_citations",
    "workflow_traces",
    "select_briefing_context",
    "validate_graph",
    "markdown_report",
    "lexical_search",
    "rerank",
    "pack_context",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, shuffle_partitions=int(cpus) * 2)
    registry.load()
    # One small action starts the executor threads before the clock does.
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        staging.forget_shared()
        start = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
