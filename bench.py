"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from millrace.plans.samples import QUERIES

#: Stream-shaped operators, joins, windowed statistics and serving queries.
HEADLINE = ["province_stats", "order_wide", "payment_wide", "product_stats", "visitor_stats", "is_new_repair", "unique_visitors", "bounces_v2", "keyword_stats", "keyword_product_stats", "gmv_by_brand", "gmv_by_category", "visitor_by_hour", "keyword_score", "log_split_display", "route_prune"]


def main() -> None:
    root, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(sorted(times[1:])[1], 3)  # the median of three warm runs
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": root.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
