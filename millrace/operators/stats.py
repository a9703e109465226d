"""Windowed statistics: visitors, products, provinces, keywords. All are streaming-safe.

Distinct orders are counted exactly, on batches and streams alike, by grouping by the order first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GOOD_REVIEWS, WINDOW
from ..functions.metrics import by_source, metric_row, union_all
from ..functions.text import tokens
from ..functions.time import window_text
from .dims import DimSpec, join_dims
from .visits import is_entry

VISITOR_DIMS = ["vc", "ch", "ar", "is_new"]
VISITOR_METRICS = dict.fromkeys(["uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"], "bigint")


def again(df: DataFrame, window: str) -> Column:
    """The window `w` of rows that were grouped by it, to group by once more; streams need it as a window, for its watermark."""
    return (F.window("w", window) if df.isStreaming else F.col("w")).alias("w")


def visitor_metrics(pages: DataFrame, visitors: DataFrame, bounced: DataFrame) -> DataFrame:
    """Rows (et, dims, metrics) of page views with their time spent, sessions, unique visitors and bounces.

    A page view and the session it opens come from one pass over the pages."""
    keys = ["et", *VISITOR_DIMS]
    during = F.coalesce(F.col("during_time"), F.lit(0))
    views = metric_row(pages, keys, VISITOR_METRICS, pv_ct=F.lit(1), dur_sum=during, sv_ct=is_entry(F.col("last_page_id")).cast("int"))
    return union_all([views, metric_row(visitors, keys, VISITOR_METRICS, uv_ct=F.lit(1)), metric_row(bounced, keys, VISITOR_METRICS, uj_ct=F.lit(1))])


def visitor_flag_stats(pages: DataFrame, window: str = WINDOW) -> DataFrame:
    """The same statistics of pages that carry their flags (visits.flagged), in one aggregation."""
    rows = metric_row(pages, ["et", *VISITOR_DIMS], VISITOR_METRICS, uv_ct=F.col("uv"), pv_ct=F.lit(1), sv_ct=is_entry(F.col("last_page_id")).cast("int"), uj_ct=F.col("uj"), dur_sum=F.coalesce(F.col("during_time"), F.lit(0)))
    return _visitor_windows(rows, window)


def visitor_stats(pages: DataFrame, visitors: DataFrame, bounced: DataFrame, window: str = WINDOW) -> DataFrame:
    return _visitor_windows(visitor_metrics(pages, visitors, bounced), window)


def _visitor_windows(rows: DataFrame, window: str) -> DataFrame:
    out = rows.groupBy(F.window("et", window).alias("w"), *VISITOR_DIMS).agg(*(F.sum(m).alias(m) for m in VISITOR_METRICS))
    return out.select(*window_text(F.col("w")), *VISITOR_DIMS, *VISITOR_METRICS, F.unix_millis(F.col("w")["end"]).alias("ts"))


MONEY = "decimal(20,2)"
PRODUCT_METRICS = {
    "display_ct": "bigint", "click_ct": "bigint", "favor_ct": "bigint", "cart_ct": "bigint", "order_sku_num": "bigint", "order_amount": MONEY,
    "payment_amount": MONEY, "refund_amount": MONEY, "comment_ct": "bigint", "good_comment_ct": "bigint",
}
#: Flag of a row's order -> the count of distinct orders that have it.
ORDER_SETS = {"ordered": "order_ct", "paid": "paid_order_ct", "refunded": "refund_order_ct"}


def product_row(df: DataFrame, arrival: str | None = None, **own: Column) -> DataFrame:
    """Rows (et, sku_id) of one or several sources that are one table, with their metrics, order_id and its flags."""
    order_id = own.pop("order_id", F.lit(None)).cast("bigint").alias("order_id")
    flags = [own.pop(name, F.lit(0)).cast("int").alias(name) for name in ORDER_SETS]
    order = [F.col(arrival).alias("arrival")] if arrival else []
    return metric_row(df, ["et", "sku_id", *order, order_id, *flags], PRODUCT_METRICS, **own)


#: How each source becomes product rows. Sources carry et and sku_id (displays and clicks: item).
PRODUCT_SOURCES = {
    "display": lambda df, at=None: product_row(df.filter("item_type = 'sku_id'").withColumn("sku_id", F.col("item").cast("bigint")), at, display_ct=F.lit(1)),
    "click": lambda df, at=None: product_row(df.filter("page_id = 'good_detail' AND item IS NOT NULL").withColumn("sku_id", F.col("item").cast("bigint")), at, click_ct=F.lit(1)),
    "favor": lambda df, at=None: product_row(df, at, favor_ct=F.lit(1)),
    "cart": lambda df, at=None: product_row(df, at, cart_ct=F.lit(1)),
    "order": lambda df, at=None: product_row(df, at, order_sku_num=F.col("sku_num"), order_amount=F.col("split_total_amount"), order_id=F.col("order_id"), ordered=F.lit(1)),
    "payment": lambda df, at=None: product_row(df, at, payment_amount=F.col("split_total_amount"), order_id=F.col("order_id"), paid=F.lit(1)),
    "refund": lambda df, at=None: product_row(df, at, refund_amount=F.col("refund_amount"), order_id=F.col("order_id"), refunded=F.lit(1)),
    "comment": lambda df, at=None: product_row(df, at, comment_ct=F.lit(1), good_comment_ct=F.col("appraise").isin(*GOOD_REVIEWS).cast("int")),
}


def product_metrics(sources: dict[str, DataFrame], arrival: str | None = None) -> DataFrame:
    return union_all([PRODUCT_SOURCES[name](df, arrival) for name, df in sources.items()])


def product_stats(sources: dict[str, DataFrame], window: str = WINDOW, refund_mode: str = "sum", arrival: str = "arrival") -> DataFrame:
    """Metrics by window and sku; ts is the earliest row's. refund_mode='double_add' counts every refund but the first row's
    twice; it needs the column `arrival` in all sources to say which row is first."""
    double = refund_mode == "double_add"
    return product_windows(product_metrics(sources, arrival if double else None), window, double)


def product_windows(rows: DataFrame, window: str = WINDOW, double_refunds: bool = False) -> DataFrame:
    """The statistics of product rows. Rows are summed by order first, where each order's flags are counted once: no row is
    copied for a distinct count, and a product that is in very many orders is spread over tasks. On streams these are two
    stateful steps one after the other: no state holds a set that grows with a product's orders. In batches, rows without an order
    go to the second sum as they are."""
    keyed = rows.withColumn("w", F.window("et", window))
    loose = None
    if not rows.isStreaming and not double_refunds:
        loose = keyed.filter("order_id IS NULL").select("w", "sku_id", "order_id", *PRODUCT_METRICS, *ORDER_SETS, F.unix_millis("et").alias("ts"))
        keyed = keyed.filter("order_id IS NOT NULL")
    parts = [F.sum(m).alias(m) for m in PRODUCT_METRICS] + [F.max(flag).alias(flag) for flag in ORDER_SETS]
    first = [F.min_by(F.struct("arrival", "refund_amount"), "arrival").alias("first")] if double_refunds else []
    keyed = keyed.groupBy("w", "sku_id", "order_id").agg(*parts, *first, F.min(F.unix_millis("et")).alias("ts"))
    if loose is not None:
        keyed = keyed.unionByName(loose)
    counts = [F.sum(F.when(F.col("order_id").isNotNull(), F.col(flag)).otherwise(0)).cast("bigint").alias(name) for flag, name in ORDER_SETS.items()]
    refund = F.sum("refund_amount")
    if double_refunds:
        refund = 2 * refund - F.min_by("first.refund_amount", "first.arrival")
    sums = [F.sum(m).cast(kind).alias(m) for m, kind in PRODUCT_METRICS.items() if m != "refund_amount"]
    out = keyed.groupBy(again(keyed, window), "sku_id").agg(*sums, refund.cast(MONEY).alias("refund_amount"), *counts, F.min("ts").alias("ts"))
    return out.select(*window_text(F.col("w")), "sku_id", *PRODUCT_METRICS, *ORDER_SETS.values(), "ts")


PROVINCE_NAMES = ["province_name", "area_code", "iso_code", "iso_3166_2"]


def province_stats(wide: DataFrame, window: str = WINDOW, as_of: Column | None = None, names: DimSpec | None = None) -> DataFrame:
    """Amount and distinct orders by window and province; ts is the time given. names: the look-up of a province's names, where
    facts have its id alone: they are joined to the sums, not to the facts."""
    dims = ["province_id", *(PROVINCE_NAMES if names is None else [])]
    by_order = wide.groupBy(F.window("et", window).alias("w"), *dims, "order_id").agg(F.sum("split_total_amount").alias("order_amount"))
    out = by_order.groupBy(again(by_order, window), *dims).agg(F.sum("order_amount").cast(MONEY).alias("order_amount"), F.count("order_id").alias("order_count"))
    ts = F.unix_millis(as_of) if as_of is not None else F.unix_millis(F.col("w")["end"])
    if names is not None:
        out = join_dims(out, [names])
    return out.select(*window_text(F.col("w")), "province_id", *PROVINCE_NAMES, "order_amount", "order_count", ts.alias("ts"))


def keyword_stats(pages: DataFrame, window: str = WINDOW) -> DataFrame:
    """Words of searches on the list page by window."""
    asked = pages.filter("item IS NOT NULL AND page_id = 'good_list'").select("et", F.explode(tokens(F.col("item"))).alias("keyword"))
    out = asked.groupBy(F.window("et", window).alias("w"), "keyword").agg(F.count(F.lit(1)).alias("ct"))
    return out.select(*window_text(F.col("w")), "keyword", F.lit("search").alias("source"), "ct")


def keyword_product_stats(products: DataFrame, name: str = "spu_name") -> DataFrame:
    """Clicks, orders and cart additions by word of the product's name and window, a row for each that is positive."""
    busy = products.filter("click_ct > 0 OR order_ct > 0 OR cart_ct > 0")
    words = busy.select("stt", "edt", "click_ct", "order_ct", "cart_ct", F.explode(tokens(F.col(name))).alias("keyword"))
    summed = words.groupBy("keyword", "stt", "edt").agg(*(F.sum(c).alias(c) for c in ("click_ct", "order_ct", "cart_ct")))
    pairs = by_source({"click": F.col("click_ct"), "order": F.col("order_ct"), "cart": F.col("cart_ct")})
    return summed.select("stt", "edt", "keyword", F.explode(pairs).alias("p")).select("stt", "edt", "keyword", "p.source", "p.ct")
