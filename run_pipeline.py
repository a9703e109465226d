"""python run_pipeline.py JOB ROOT [--once]: runs a streaming job over the topics below ROOT."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from millrace.streaming import jobs
from millrace.streaming.processors import configure


JOBS = {
    "split_logs": lambda s, a: jobs.split_logs(s, a.root, a.once),
    "route_changes": lambda s, a: jobs.route_changes(s, a.root, a.routes, a.once),
    "unique_visitors": lambda s, a: jobs.keep_unique_visitors(s, a.root, a.once),
    "bounces": lambda s, a: jobs.keep_bounces(s, a.root, a.variant, a.once),
    "order_wide": lambda s, a: jobs.keep_order_wide(s, a.root, None, a.once),
    "payment_wide": lambda s, a: jobs.keep_payment_wide(s, a.root, a.once),
    "visitor_stats": lambda s, a: jobs.keep_visitor_stats(s, a.root, a.window, a.once),
    "product_stats": lambda s, a: jobs.keep_product_stats(s, a.root, a.window, a.once),
    "province_stats": lambda s, a: jobs.keep_province_stats(s, a.root, None, a.window, a.once, stamped=True),
    "keyword_stats": lambda s, a: jobs.keep_keyword_stats(s, a.root, a.window, a.once),
    "keyword_products": lambda s, a: jobs.keep_keyword_products(s, a.root, a.once),
}


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("root")
    parser.add_argument("--routes", help="folder of the route configuration")
    parser.add_argument("--variant", choices=["v1", "v2"], default="v2", help="of bounces")
    parser.add_argument("--window", default="5 seconds")
    parser.add_argument("--once", action="store_true", help="end when what is there is read")
    given = parser.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    configure(spark)
    JOBS[given.job](spark, given).awaitTermination()


if __name__ == "__main__":
    main()
