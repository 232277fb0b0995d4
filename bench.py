"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from sedgetable.plans import registry  # noqa: E402

HEADLINE = [
    "f00_all_row_local_findings",
    "f01_exact_duplicate_rows",
    "f24_geographic_outliers",
    "p01_import_profile",
    "p04_column_profile",
    "p05_common_values",
    "q01_literal_row_search",
    "r02_link_counts",
    "r03_literal_left_join",
    "r03_literal_left_join_repeated_parents",
    "c01_key_aligned_comparison",
    "c05_table_fingerprint",
    "t09_remove_duplicate_rows",
    "t17_reviewed_dates",
    "t21_reviewed_codes",
    "v04_types",
    "v11_declared_keys",
    "h01_batch_trim_summary",
    "h02_apply_edits",
    "h04_table_as_of",
    "src01_strict_delimited_scan",
    "src14_record_numbers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sedgetable-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry()
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
