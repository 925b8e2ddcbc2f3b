"""Command line: ``spark-submit faultline/plans/command.py train|score|explain ...``."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import date

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession  # noqa: E402

from faultline.constants import HIGH_RISK, HORIZONS  # noqa: E402
from faultline.operators.scoring import riskiest, wide_scores  # noqa: E402
from faultline.plans import maintenance  # noqa: E402
from faultline.sources.failure_log import read_failure_log  # noqa: E402
from faultline.sources.storage import write_predictions  # noqa: E402


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Failure-log analytics")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("train", "score", "explain"):
        job = jobs.add_parser(name)
        job.add_argument("--log", required=True, help="failure log")
        job.add_argument("--format", default="csv", help="csv, parquet, json or orc")
        job.add_argument("--date-format", help="pattern of date text; ISO and common day-first forms are known")
        if name != "explain":
            job.add_argument("--models", required=True, help="model store")
        if name == "train":
            job.add_argument("--horizons", type=int, nargs="+", default=list(HORIZONS))
        else:
            job.add_argument("--output", required=True)
        if name == "score":
            job.add_argument("--version", default="latest")
            job.add_argument("--output-format", default="csv", choices=("csv", "parquet"))
        if name == "explain":
            job.add_argument("--features", nargs="+", default=["tbf", "cumulative_failures"])
            job.add_argument("--window-days", type=int, default=7)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("faultline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    log = read_failure_log(spark, args.log, args.format, args.date_format)
    if args.job == "train":
        version, results = maintenance.train(spark, log, args.models, maintenance.Settings(horizons=args.horizons))
        for h, r in results.items():
            print(f"{version} {h}d {r['model_name']} f1={r['metrics_test'].get('f1', 0):.3f}")
    elif args.job == "score":
        long = maintenance.score(spark, log, args.models, args.version)
        horizons = sorted(r["horizon"] for r in long.select("horizon").distinct().collect())
        write_predictions(wide_scores(long, horizons), args.output, date.today().isoformat(), args.output_format)
        riskiest(long, [HIGH_RISK], 5, max(horizons)).select("asset_id", "probability", "risk").show(truncate=False)
    else:
        maintenance.explain(log, args.features, args.window_days).write.mode("overwrite").parquet(args.output)


if __name__ == "__main__":
    main()
