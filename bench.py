"""Seconds per headline query; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 4) set data and cores.
Each query is built and run to the last row (no-op sink); best of two runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strataflow.plans.catalog import QUERIES  # noqa: E402
from strataflow.session import local_session  # noqa: E402

HEADLINE = (
    "a23_risk_benchmark",
    "a20_section_performance",
    "a22_gas_response",
    "a19_daily_progress",
    "a24_production_summary",
    "a6_time_breakdown",
    "a8_longest_npt_event",
    "a11_daily_progress_stats",
    "w1_hole_phases",
    "w2_phase_details",
    "w3_depth_reversals",
    "a12_mudlog_section_stats",
    "a15_issue_summary",
    "a16_contributing_factors",
    "a17_mud_problem_vs_normal",
    "j2_asof_formation",
    "j4_nearest_hole",
    "j5_interval_rop",
    "j6_assign_to_window",
    "a25_compare_wells",
    "r1_keyword_search",
    "r2_semantic_search",
    "r4_ddr_narrative",
    "r6_bha_comment_evidence",
    "u1_audit_answers",
    "s3_ddr_status",
    "x6_run_performance",
)


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:]
    spark = local_session(os.environ.get("BENCH_CPUS", "4"), "bench")
    times = {}
    for name in HEADLINE:
        if only and not any(part in name for part in only):
            continue
        seconds(spark, name, folder)
        times[name] = round(min(seconds(spark, name, folder) for _ in range(2)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, best of two after warm-up",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
