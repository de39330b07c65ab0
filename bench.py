"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from catalog import QUERIES  # noqa: E402
from catalog.base import cleaned, raw  # noqa: E402
from wardbook import prepare  # noqa: E402

HEADLINE = [
    "null_sentinel_codes",
    "derive_predictor_flags",
    "scale_price",
    "fill_id_gaps",
    "clean_visits",
    "validate_visits",
    "violating_cells",
    "bad_code_values",
    "repair_visits",
    "repair_visits_counts",
    "duplicate_visits",
    "missing_profile",
    "describe_ages",
    "describe_prices",
    "box_document_lengths",
    "count_many_columns",
    "histogram_quantity",
    "finding_mechanism_risk",
    "return_rate_by_line",
    "mechanism_shares_by_age_group",
    "mechanism_gap_by_gender",
    "rate_matrix_mechanism_age",
    "predictor_rates_by_age_group",
    "ct_use_by_demographics",
    "risk_ratio_stability",
    "decision_rule_metrics",
    "threshold_for_sensitivity",
    "cv_threshold",
    "logistic_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    first, times = {}, {}
    # The stored tables the queries start from, timed on their own.
    for name, build in (("store_visits", raw), ("store_cleaned", cleaned)):
        start = time.perf_counter()
        build(spark, sf_dir)
        first[name] = times[name] = round(time.perf_counter() - start, 3)
    # Every query runs twice in full. The first run also pays for loading
    # classes and compiling generated code; both times are reported.
    for results in (first, times):
        for name in HEADLINE:
            start = time.perf_counter()
            # A no-op sink makes Spark compute every row and column of the result.
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            results[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    report = {"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir}
    print(json.dumps(report | {"first_run": first, "first_run_total": round(sum(first.values()), 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
