"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; the median is reported, with the number of
exchanges in the plan. The timed part builds the plan and consumes every row without moving rows to the driver.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from gradeframe.plans.catalog import QUERIES
from gradeframe.session import get_spark

HEADLINE = [
    "G1_macro_metrics", "G2_summary_by_split", "G3_summary_aggregated", "G4_summary_by_subject",
    "G6_run_metrics", "G8_performance_summary", "G11_confusion_none", "L4_box_latency",
    "H1_stratified_cap", "H1_stratified_cap_large", "H2_upsert", "F1_score_answers", "F4_pending_questions",
    "G14_model_scoreboard", "G12_calibration", "N3_gate_report", "M5_apply_changes",
    "C2_extract_cot_first", "C3_extract_tagged_last", "D2_D5_parse_pages", "D9_eliminate",
    "E1_to_chat", "G20_split_profile", "K1_retrieve_topk", "K1_retrieve_topk_blocks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    def exchanges(name: str) -> int:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        return len(re.findall(r"(?<!Reused)Exchange ", plan))

    seconds, shuffles = {}, {}
    for name in names:
        once(name)
        shuffles[name] = exchanges(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus, "runs": runs, "exchanges": shuffles,
    }))


if __name__ == "__main__":
    main()
