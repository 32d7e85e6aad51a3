"""Runs the headline queries on local cores and prints one line of JSON with their seconds."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from histra import catalog

HEADLINE = (
    "h1_pricing_summary", "h3_shipping_priority", "h5_local_supplier_volume", "h6_revenue_change", "h9_product_profit", "h13_customer_distribution", "h18_large_orders", "h21_waiting_suppliers",
    "w5_read_125", "w15_max_125", "w25_sum_125", "c5_letter_key", "c18_big_orders", "s4_operations", "v2_v5_read_violations", "v17_statistics", "g5_coalesced_choices", "g11_edge_counts",
    "g21_serializable", "q2_join", "r1_distribution_by_type",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = catalog.queries(), {}
    found["h1_pricing_summary"](spark, sf_dir).collect()  # the JVM's and the files' first touch
    for name in HEADLINE:
        began = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
