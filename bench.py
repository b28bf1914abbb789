"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder and ``BENCH_CPUS`` the number of cores. The trip table
and the cleaned table are stored first, as they would be in use; that time is reported as
``setup``. Each query then runs once to warm up and three times for its median. A run executes
the whole plan and writes the result to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tests.session import local_session
from triplens.plans.catalog import QUERIES, cleaned, trips

HEADLINE = (
    "null_profile",
    "null_rate_by",
    "exact_dups",
    "near_dups_strict_counts",
    "pair_category_summary",
    "ordered_neighbours",
    "refund_rows",
    "rule_counts",
    "negative_matrix",
    "fare_formula_flags",
    "total_check_by",
    "outlier_thresholds",
    "discrepancy_overall",
    "discrepancy_by_payment",
    "discrepancy_zone_top_pickup",
    "top_gaps",
    "negative_by_column_split",
    "issues_by_vendor",
    "clean_trips",
    "cleaning_report",
    "kpi_summary",
    "payment_behavior",
    "histogram_total",
    "sample_points",
    "zone_agg",
    "band_matrix",
)


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    setup = {
        "trips": seconds(lambda: trips(spark, folder)),
        "clean": seconds(lambda: cleaned(spark, folder)),
    }
    times = {}
    for name in HEADLINE:

        def run(name=name):
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

        run()
        times[name] = round(statistics.median(seconds(run) for _ in range(3)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "setup": {k: round(v, 3) for k, v in setup.items()},
                "trips": trips(spark, folder).count(),
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
