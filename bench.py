"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from boxeval.queries import QUERIES
from boxeval.session import local_session

HEADLINE = [
    "detector_quality",
    "g2_iou",
    "j1_box_pairs",
    "j2_greedy_match",
    "j3_greedy_match_rounds",
    "j6_duplicates",
    "j7_nearest_truth",
    "k1_top_k",
    "k2_diverse_top_k",
    "k4_abstain_ambiguous",
    "k4_abstain_rounds",
    "a5_diff_boards",
    "m1_score_predictions",
    "m2_measure_input",
    "m4_summarise_sets",
    "m9_distribution",
    "m10_cold_warm",
    "m12_calibration",
    "m14_delta",
    "m15_failure_reasons",
    "m18_reliability_table",
    "p2_plan_truth",
    "q2_assess_case",
    "q3_threshold_gate",
    "q5_unsafe_results",
    "v1_check_fields",
    "v4_check_cross_field",
    "h2_verify_pins",
    "h3_set_fingerprint",
    "h6_exact_copies",
    "l3_find_violations",
    "w3_latest_request",
    "w5_run_number",
    "r2_summed_area",
    "r5_checker_score",
    "r9_scan_pages",
    "f1_score_batch",
    "t1_request_lifecycle",
    "x1_redact",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # start the executor threads and the code generator before anything is timed
    spark.range(1000).selectExpr("sum(id)").collect()
    chosen = sys.argv[1:] or HEADLINE
    # one query that doesn't count, so that the first one doesn't pay for all that the session loads
    QUERIES["g2_iou"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "boxeval headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
