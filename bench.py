"""Seconds per headline query: one JSON line on stdout.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose the
data and the cores. Every query runs over whole tables into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

import check
from faultline.plans.catalog import QUERIES

HEADLINE = (
    "repeat_rates_by_region", "io1_failure_log", "p1_normalized_texts", "p5_outliers_iqr", "p6_last_of_duplicates",
    "p9_scale_robust", "w1_w3_series", "w9_feature_table", "w10_horizon_targets", "w14_padded_sequences",
    "t2_temporal_split", "t4_undersample", "t6_stratified_folds", "a1_aggregate_by_asset", "a7_confusion_metrics",
    "a8_a9_ranking_metrics", "a13_best_threshold", "r1_kaplan_meier_censored", "r2_weibull_by_region",
    "w12_window_statistics", "c1_c2_anomalies", "c3_similar_failures", "c8_cause_report", "j1_match_outcomes",
    "w11_metrics_over_time", "a17_drift", "j3_latest_rows", "io9_report_top_assets", "x3_top_drivers",
    "m1_m5_m8_training", "m9_io6_io7_batch_scoring",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = check.session(cpus)
    QUERIES["a3_distinct_assets"](spark, folder).collect()  # start the engine
    names = sys.argv[1:] or HEADLINE
    took = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf, "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
