"""The warehouse's inputs made of the retail sample tables (orders, lineitem, events, ...), and a query for each operator.

Money is cast to decimals before it is summed, so sums are exact in any order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DATETIME
from ..functions.metrics import by_source, metric_row, union_all
from ..functions.text import tokens
from ..functions.time import age_on, day_start, from_ms, on_day, to_ms
from ..operators import binlog, logs, orders, stats, visits
from ..operators.dims import DimSpec, join_dims
from ..sources.sinks import latest
from ..sources.topics import read_table
from . import serving

MONEY = "decimal(20,2)"
DAY = 19960115
EVENT_DAY = 20240115
HOUR_MS = 3_600_000


def as_logs(p: DataFrame) -> DataFrame:
    """Pages as rows of the log topic, with common, start, page and displays by kind of event."""
    common = F.create_map(F.lit("mid"), F.col("mid"), F.lit("ch"), F.col("ch"), F.lit("ar"), F.col("ar"), F.lit("ts"), F.lit("common"))
    page = F.create_map(F.lit("page_id"), F.col("page_id"), F.lit("item"), F.col("item"), F.lit("last_page_id"), F.col("last_page_id"))
    shown = F.array(*(F.create_map(F.lit("item"), F.lit(str(i)), F.lit("item_type"), F.lit("sku_id" if i else "promotion"), F.lit("page_id"), F.lit("display"), F.lit("pos"), F.lit("x")) for i in range(2)))
    return p.select(
        "arrival", common.alias("common"), F.when(F.col("page_id") == "signup", F.create_map(F.lit("entry"), F.lit("icon"))).alias("start"),
        F.when(F.col("page_id") != "error", page).alias("page"), F.when(F.col("page_id").isin("view", "purchase", "signup"), shown).alias("displays"), "ts",
    )


class Samples:
    """Sample tables as warehouse inputs; every property is a plan, nothing is read until it is used."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.root, name)

    @property
    def pages(self) -> DataFrame:
        """A page log of events: entries are signups and views."""
        e = self.table("events")
        entry = F.col("event_type").isin("signup", "view")
        k = F.get_json_object("props", "$.k")
        return e.select(
            F.col("event_id").alias("arrival"), F.col("user_id").cast("string").alias("mid"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("ts").cast("timestamp").alias("et"),
            F.col("event_type").alias("page_id"), F.when(~entry, "home").alias("last_page_id"), F.lit("v1").alias("vc"), F.col("event_type").alias("ch"), k.alias("ar"),
            F.when(F.col("event_id") % 3 == 0, "1").otherwise("0").alias("is_new"), F.floor("value").cast("bigint").alias("during_time"), F.concat(F.lit("item "), k).alias("item"),
        )

    @property
    def logs(self) -> DataFrame:
        """Documents with common, start, page and displays, by kind of event."""
        return as_logs(self.pages)

    @property
    def orders(self) -> DataFrame:
        o, c = self.table("orders"), self.table("customer").select("c_custkey", "c_nationkey")
        met = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
        at = F.col("o_orderdate").cast("timestamp")
        return met.select(
            F.col("o_orderkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("province_id"), F.col("o_orderstatus").alias("order_status"), F.col("o_custkey").alias("user_id"),
            F.col("o_totalprice").cast(MONEY).alias("total_amount"), *(F.lit(None).cast(MONEY).alias(n) for n in ("activity_reduce_amount", "coupon_reduce_amount", "original_total_amount", "feight_fee")),
            F.date_format(at, DATETIME).alias("create_time"), F.date_format(at, "yyyy-MM-dd").alias("create_date"), F.date_format(at, "HH").alias("create_hour"), at.alias("et"),
        )

    @property
    def details(self) -> DataFrame:
        return self.details_on(None)

    def details_on(self, day: int | None) -> DataFrame:
        """Order lines, of one day or all; the day is a range of the stored column, which the scan gets."""
        at, items = F.col("l_shipdate").cast("timestamp"), self.table("lineitem")
        if day:
            start = F.to_timestamp_ntz(F.lit(str(day)), F.lit("yyyyMMdd"))
            items = items.filter((F.col("l_shipdate") >= start) & (F.col("l_shipdate") < start + F.expr("interval 1 day")))
        return items.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku_id"), F.col("l_extendedprice").cast(MONEY).alias("order_price"),
            F.col("l_quantity").cast("bigint").alias("sku_num"), F.col("l_returnflag").alias("sku_name"), F.date_format(at, DATETIME).alias("create_time"), F.col("l_extendedprice").cast(MONEY).alias("split_total_amount"),
            *(F.lit(None).cast(MONEY).alias(n) for n in ("split_activity_amount", "split_coupon_amount")), F.col("l_suppkey").alias("suppkey"), F.col("l_linestatus").alias("status"), at.alias("et"),
        )

    @property
    def payments(self) -> DataFrame:
        d = self.details
        return d.select("id", "order_id", F.col("suppkey").alias("user_id"), F.col("split_total_amount").alias("total_amount"), F.col("sku_name").alias("subject"), F.col("status").alias("payment_type"), "create_time", F.lit(None).cast("string").alias("callback_time"), "et")

    @property
    def dims(self) -> list[DimSpec]:
        part = self.table("part")
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        return [
            DimSpec(self.table("customer"), "user_id", {"user_gender": "c_mktsegment"}, "c_custkey"),
            DimSpec(nation, "province_id", {"province_name": "n_name", "province_area_code": F.col("n_regionkey").cast("string"), "province_iso_code": "r_name", "province_3166_2_code": F.col("n_nationkey").cast("string")}, "n_nationkey"),
            DimSpec(part, "sku_id", {"spu_name": "p_name", "tm_name": "p_brand", "category3_name": "p_type"}, "p_partkey"),
        ]

    @property
    def province_facts(self) -> DataFrame:
        """Order lines with their order's province, by its id."""
        o = self.orders.select(F.col("id").alias("o_id"), "province_id", "et")
        return self.details.drop("et").join(o, F.col("order_id") == F.col("o_id")).select("order_id", "split_total_amount", "et", "province_id")

    @property
    def province_names(self) -> DimSpec:
        d = self.dims[1]
        short = {"province_area_code": "area_code", "province_iso_code": "iso_code", "province_3166_2_code": "iso_3166_2"}
        return DimSpec(d.table, d.fk, {short.get(k, k): v for k, v in d.columns.items()}, d.key)

    @property
    def order_facts(self) -> DataFrame:
        """The same with the province's names."""
        return join_dims(self.province_facts, [self.province_names])

    @property
    def product_sources(self) -> dict[str, DataFrame]:
        d = self.details.withColumn("arrival", F.col("id"))
        ev = self.pages.withColumns({"item_type": F.when(F.col("page_id") == "view", "sku_id"), "item": F.col("ar")})
        return {
            "display": ev, "click": ev.withColumn("page_id", F.when(F.col("page_id") == "click", "good_detail")),
            "favor": ev.filter("page_id = 'signup'").withColumn("sku_id", F.col("ar").cast("bigint")), "cart": ev.filter("page_id = 'purchase'").withColumn("sku_id", F.col("ar").cast("bigint")),
            "order": d, "payment": d.filter("status = 'F'"), "refund": d.filter("sku_name = 'R'").withColumn("refund_amount", F.col("split_total_amount")),
            "comment": d.withColumn("appraise", F.when(F.col("sku_name") == "A", "1204").when(F.col("sku_name") == "N", "1205").otherwise("1201")),
        }

    @property
    def product_rows(self) -> DataFrame:
        """The product sources that are one table in one pass: order lines, and events."""
        order, event = F.col("order_id"), F.col("page_id")
        paid, back, seen = F.col("status") == "F", F.col("sku_name") == "R", F.col("sku_name").isin("A", "N")
        none = F.lit(0).cast(MONEY)
        items = stats.product_row(
            self.details, order_id=order, ordered=F.lit(1), paid=paid, refunded=back, order_sku_num=F.col("sku_num"), order_amount=F.col("split_total_amount"), comment_ct=F.lit(1), good_comment_ct=seen,
            payment_amount=F.when(paid, F.col("split_total_amount")).otherwise(none), refund_amount=F.when(back, F.col("split_total_amount")).otherwise(none),
        )
        kinds = {"display_ct": "view", "click_ct": "click", "favor_ct": "signup", "cart_ct": "purchase"}
        events = self.pages.filter(event.isin(*kinds.values()) & F.col("ar").isNotNull()).withColumn("sku_id", F.col("ar").cast("bigint"))
        return items.unionByName(stats.product_row(events, **{m: event == k for m, k in kinds.items()}))

    def products(self, day: int) -> DataFrame:
        """A day's orders by product, with names; only what orders fill is asked for, so no other source is read."""
        return join_dims(stats.product_stats({"order": self.details_on(day)}, "1 day"), self.dims[2:])

    def visitor_table(self, day: int | None = None) -> DataFrame:
        """Visitor statistics by hour, of one day or all. Bounces of a day also see what follows it within their time."""
        within = 6 * HOUR_MS
        p = seen = self.pages
        if day:
            seen = p.filter((F.col("et") >= day_start(day)) & (F.col("et") < day_start(day) + F.expr(f"interval {24 * HOUR_MS + within} milliseconds")))
        rows = visits.flagged(seen, on_day(F.col("et"), day) if day else None, within, ever=p if day else None)
        return stats.visitor_flag_stats(rows, "1 hour")

    @property
    def keyword_table(self) -> DataFrame:
        searched = stats.keyword_stats(self.pages.withColumn("page_id", F.when(F.col("page_id") == "view", "good_list")), "1 day")
        return searched.unionByName(self.keyword_products)

    @property
    def keyword_products(self) -> DataFrame:
        counted = self.pages.groupBy(F.date_format(F.date_trunc("day", "et"), DATETIME).alias("stt"), "item").agg(
            *(F.count_if(F.col("page_id") == k).alias(c) for k, c in (("click", "click_ct"), ("purchase", "order_ct"), ("signup", "cart_ct")))
        )
        return stats.keyword_product_stats(counted.withColumn("edt", F.date_format(F.col("stt").cast("timestamp") + F.expr("interval 1 day"), DATETIME)), "item")

    @property
    def changes(self) -> DataFrame:
        """Change rows of nations and regions, of all types, some of them broken."""
        n = self.table("nation").select(F.lit("nation").alias("table"), F.col("n_nationkey").cast("int").alias("k"), F.create_map(F.lit("n_nationkey"), F.col("n_nationkey").cast("string"), F.lit("n_name"), F.col("n_name"), F.lit("secret"), F.lit("x")).alias("data"))
        r = self.table("region").select(F.lit("region").alias("table"), F.col("r_regionkey").cast("int").alias("k"), F.create_map(F.lit("r"), F.col("r_regionkey").cast("string")).alias("data"))
        kind = F.element_at(F.array(*(F.lit(x) for x in ("insert", "update", "bootstrap-insert", "delete", "bootstrap-start"))), F.col("k") % 5 + 1)
        return n.unionByName(r).select(F.when(F.col("k") != 7, "shop").alias("database"), "table", kind.alias("type"), "data")

    @property
    def routes(self) -> DataFrame:
        rows = [("nation", "insert", "KAFKA", "dwd_nation", "n_nationkey,n_name", "n_nationkey", None), ("nation", "update", "hbase", "dim_nation", "n_nationkey, n_name", None, None), ("region", "insert", "clickhouse", "x", "r", None, None)]
        return self.spark.createDataFrame(rows, "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string, sink_extend string")


Query = Callable[[SparkSession, str], DataFrame]


def _of(build: Callable[[Samples], DataFrame]) -> Query:
    return lambda spark, root: build(Samples(spark, root))


def _seen(s: Samples, mode: str) -> DataFrame:
    return visits.unique_visitors(s.pages, mode).select("arrival", "mid", "ts")


def _bounced(s: Samples, variant: str) -> DataFrame:
    return visits.bounces(s.pages, variant, within_ms=6 * HOUR_MS).select("arrival", "mid", "ts")


def _map_text(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("null")))), ";")


def _order_wide(s: Samples) -> DataFrame:
    out = orders.widen(s.orders, s.details, s.dims, "5 days", "5 days")
    return out.select("detail_id", "order_id", "province_id", "user_id", "total_amount", "sku_id", "sku_num", "split_total_amount", "create_date", "create_hour", "user_gender", "province_name", "province_iso_code", "spu_name", "tm_name", "category3_name")


def _payment_wide(s: Samples) -> DataFrame:
    wide = s.orders.withColumnRenamed("id", "order_id")
    out = orders.payment_wide(s.payments, wide, "45 days", "1 day")
    return out.select("payment_id", "order_id", "user_id", "total_amount", "subject", "payment_type", "payment_create_time", "order_create_time", "province_id", "order_status")


def _sql_province(s: Samples) -> DataFrame:
    """The same statistics as SQL text over a temporary view."""
    s.order_facts.createOrReplaceTempView("millrace_order_facts")
    return s.spark.sql(f"""
        SELECT date_format(window.start, '{DATETIME}') AS stt, date_format(window.end, '{DATETIME}') AS edt, province_id, province_name, area_code,
               CAST(sum(split_total_amount) AS {MONEY}) AS order_amount, count(DISTINCT order_id) AS order_count
        FROM millrace_order_facts GROUP BY window(et, '1 day'), province_id, province_name, area_code""")


def _scalars(s: Samples) -> DataFrame:
    e = s.pages
    text = from_ms(F.col("ts"))
    return e.select("arrival", text.alias("at"), to_ms(text).alias("ms"), to_ms(F.col("mid")).alias("bad_ms"), F.substring(text, 12, 2).alias("hour"), F.lpad(F.col("ar"), 4, "0").alias("padded"), F.date_format(F.to_date("et"), "yyyyMMdd").cast("int").alias("day"), F.upper("page_id").alias("upper"), F.coalesce("last_page_id", "page_id").alias("page"))


def _ages(s: Samples) -> DataFrame:
    o = s.table("orders")
    return o.select("o_orderkey", age_on(F.col("o_orderdate").cast("date"), F.lit("2021-05-28").cast("date")).alias("age"))


def _json(s: Samples) -> DataFrame:
    back = F.from_json(F.to_json(F.struct("mid", "last_page_id", "ts")), "mid string, last_page_id string, ts bigint")
    return s.pages.select("arrival", back["mid"].alias("mid"), back["last_page_id"].alias("last_page_id"), back["ts"].alias("ts"))


def _upsert(s: Samples) -> DataFrame:
    return latest(s.pages.select("mid", "page_id", "arrival"), ["mid"], "arrival")


def _union(s: Samples) -> DataFrame:
    metrics = dict.fromkeys(["views", "buys"], "bigint")
    p = s.pages
    rows = union_all([metric_row(p.filter("page_id = 'view'"), ["mid"], metrics, views=F.lit(1)), metric_row(p.filter("page_id = 'purchase'"), ["mid"], metrics, buys=F.lit(1))])
    return rows.groupBy("mid").agg(F.sum("views").alias("views"), F.sum("buys").alias("buys"))


def _keyword_pairs(s: Samples) -> DataFrame:
    c = s.pages.groupBy("mid").agg(*(F.count_if(F.col("page_id") == k).alias(k) for k in ("click", "purchase", "signup")))
    return c.select("mid", F.explode(by_source({"click": F.col("click"), "order": F.col("purchase"), "cart": F.col("signup")})).alias("p")).select("mid", "p.source", "p.ct")


def _product_stats(s: Samples) -> DataFrame:
    out = stats.product_windows(s.product_rows, "1 day")
    return out.select("stt", "edt", "sku_id", *stats.PRODUCT_METRICS, *stats.ORDER_SETS.values(), "ts")


QUERIES: dict[str, Query] = {
    "is_new_repair": _of(lambda s: logs.repair_is_new(s.pages).select("arrival", "mid", "is_new")),
    "unique_visitors": _of(lambda s: _seen(s, "reference")),
    "unique_visitors_calendar": _of(lambda s: _seen(s, "calendar_day")),
    "unique_visitors_lifetime": _of(lambda s: _seen(s, "lifetime")),
    "bounces_v1": _of(lambda s: _bounced(s, "v1")),
    "bounces_v2": _of(lambda s: _bounced(s, "v2")),
    "log_split_start": _of(lambda s: logs.start_logs(s.logs).select("arrival", F.col("common")["mid"].alias("mid"))),
    "log_split_page": _of(lambda s: logs.page_logs(s.logs).select("arrival", F.col("page")["page_id"].alias("page_id"), F.col("page")["item"].alias("item"))),
    "log_split_display": _of(lambda s: logs.display_logs(s.logs).select("ts", _map_text(F.col("display")).alias("display"))),
    "map_access": _of(lambda s: s.logs.filter("page['item'] IS NOT NULL AND page['page_id'] = 'view'").select("arrival", F.expr("page['item']").alias("item"))),
    "etl_binlog": _of(lambda s: binlog.etl_binlog(s.changes).select("table", "type", _map_text(F.col("data")).alias("data"))),
    "route_prune": _of(lambda s: binlog.route(binlog.etl_binlog(s.changes), s.routes).select("sink_type", "sink_table", _map_text(F.col("data")).alias("data"))),
    "order_wide": _of(_order_wide),
    "payment_wide": _of(_payment_wide),
    "visitor_stats": _of(lambda s: s.visitor_table()),
    "product_stats": _of(_product_stats),
    "product_stats_by_topic": _of(lambda s: stats.product_stats(s.product_sources, "1 day").select("stt", "edt", "sku_id", *stats.PRODUCT_METRICS, *stats.ORDER_SETS.values(), "ts")),
    "province_stats": _of(lambda s: stats.province_stats(s.province_facts, "1 day", names=s.province_names).drop("ts", "iso_code", "iso_3166_2")),
    "province_stats_sql": _of(_sql_province),
    "keyword_stats": _of(lambda s: stats.keyword_stats(s.pages.withColumn("page_id", F.when(F.col("page_id") == "view", "good_list")), "1 day")),
    "keyword_documents": _of(lambda s: s.table("documents").select("doc_id", F.size(tokens(F.coalesce("text", F.lit("")))).cast("bigint").alias("words"))),
    "keyword_product": _of(_keyword_pairs),
    "keyword_product_stats": _of(lambda s: s.keyword_products),
    "gmv": _of(lambda s: serving.gmv(s.products(DAY), DAY)),
    "gmv_by_brand": _of(lambda s: serving.gmv_by_brand(s.products(DAY), DAY)),
    "gmv_by_spu": _of(lambda s: serving.gmv_by_spu(s.products(DAY), DAY)),
    "gmv_by_category": _of(lambda s: serving.gmv_by_category(s.products(DAY), DAY)),
    "province_totals": _of(lambda s: serving.province_totals(stats.province_stats(s.province_facts, "1 day", names=s.province_names), DAY)),
    "visitor_by_hour": _of(lambda s: serving.visitor_by_hour(s.visitor_table(EVENT_DAY), EVENT_DAY)),
    "visitor_by_is_new": _of(lambda s: serving.visitor_by_is_new(s.visitor_table(EVENT_DAY), EVENT_DAY)),
    "keyword_score": _of(lambda s: serving.keyword_score(s.keyword_table, EVENT_DAY)),
    "union_metrics": _of(_union),
    "upsert_latest": _of(_upsert),
    "time_functions": _of(_scalars),
    "coalesce_age": _of(_ages),
    "json_roundtrip": _of(_json),
}


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Amount and distinct orders by day and province."""
    return QUERIES["province_stats"](spark, root)
