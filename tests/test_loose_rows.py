"""Product rows without an order."""

from pyspark.sql import functions as F

from millrace.operators import stats


def test_rows_without_an_order_are_not_dealt_by_order(spark):
    at = F.timestamp_seconds(F.col("id") * 30)
    base = spark.range(40).select(at.alias("et"), (F.col("id") % 3).alias("sku_id"), F.col("id"), F.when(F.col("id") % 5 > 0, F.floor(F.col("id") / 2)).alias("order_id"), F.lit("1.25").cast("decimal(20,2)").alias("split_total_amount"), F.lit(2).cast("bigint").alias("sku_num"), F.lit("1204").alias("appraise"))
    sources = {"order": base, "payment": base.filter("id % 2 = 0"), "comment": base, "favor": base.filter("sku_id = 1")}
    out = stats.product_stats(sources, "5 minutes")
    want = {}
    for r in base.select("*", F.unix_millis("et").alias("ms")).collect():
        w = want.setdefault((r.ms // 300_000, r.sku_id), [0, 0, 0, 0, 0, set(), set(), r.ms])
        w[0] += 2
        w[1] += 125
        w[2] += 125 * (r.id % 2 == 0)
        w[3] += 1
        w[4] += r.sku_id == 1
        w[7] = min(w[7], r.ms)
        if r.order_id is not None:
            w[5].add(r.order_id)
            w[6] |= {r.order_id} if r.id % 2 == 0 else set()
    got = {(r.ts // 300_000, r.sku_id): [r.order_sku_num, int(r.order_amount * 100), int(r.payment_amount * 100), r.comment_ct, r.favor_ct, r.order_ct, r.paid_order_ct, r.ts] for r in out.collect()}
    assert got == {k: [*v[:5], len(v[5]), len(v[6]), v[7]] for k, v in want.items()}
    # Sources that have no order at all take no exchange by order.
    only = stats.product_stats({"comment": base, "favor": base}, "5 minutes")
    plan = only._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
