"""The streaming jobs: topics in, topics or result tables out, checkpointed below the root. Interval joins and windowed
statistics are the batch operators on watermarked streams; routing and upserts go batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import BOUNCE_WITHIN_MS, DELAY_MS, DELAYS, KEEP_SECONDS, RESULTS, TOPICS
from ..functions.time import event_time, to_ms
from ..operators import binlog, logs, orders, stats, visits
from ..operators.dims import DimSpec, join_dims
from ..schemas import CART_INFO, COMMENT_INFO, FAVOR_INFO, LOG, MAP, ORDER_DETAIL, ORDER_INFO, PAYMENT_INFO, REFUND_INFO
from ..sources.sinks import OpenRows, UpsertTable, as_json, buckets_of, run_stream, write_lines, write_routed, write_table, write_topic, write_topics
from ..sources.topics import as_table, read_topic, read_topics
from .processors import NewVisitorProcessor, UniqueVisitorProcessor, process


def typed(topic: DataFrame, schema: str, delay: str = DELAYS["default"]) -> DataFrame:
    """A fact topic with its event time `et` from create_time."""
    rows = orders.with_create_parts(topic.select(F.from_json("value", schema).alias("r")).select("r.*"))
    return rows.withColumn("et", event_time(to_ms(F.col("create_time")))).withWatermark("et", delay)


def marked_logs(spark: SparkSession, root: str) -> DataFrame:
    """(body, flag) of the log topic, a stream: flag '1' for a visitor's first row. Whom it has met is the processor's keyed
    state, so a batch costs its own visitors, not all that were ever met. Rows without a visitor or time are no first rows."""
    raw = logs.parsed_once(read_topic(spark, root, TOPICS["log"], True), f"common {MAP}, ts bigint")
    rows = raw.select(F.col("common")["mid"].alias("mid"), "ts", F.lit(None).cast("bigint").alias("arrival"), F.lit(False).alias("entry"), F.col("value").alias("body"))
    whole = F.col("mid").isNotNull() & F.col("ts").isNotNull()
    marked = process(rows.filter(whole), NewVisitorProcessor(), DELAYS["default"]).select("body", "flag")
    return marked.unionByName(rows.filter(~whole).select("body", F.lit("0").alias("flag")))


def split_logs(spark: SparkSession, root: str, available_now: bool = False) -> StreamingQuery:
    """ods_log, with the new-visitor mark repaired, to start, page and display topics. Rows later than the watermark drop."""

    def each(batch: DataFrame, number: int) -> None:
        parsed = logs.parsed_once(batch.select(F.col("body").alias("value"), "flag"), LOG)
        parsed = parsed.withColumn("common", logs.put(F.col("common"), "is_new", F.col("flag")))
        write_topics(logs.split_lines(parsed), root, {name: TOPICS[name] for name in ("start", "page", "display")}, number)

    return run_stream(marked_logs(spark, root), each, f"{root}/_checkpoints/split_logs", available_now=available_now)


def route_changes(spark: SparkSession, root: str, routes: str, available_now: bool = False) -> StreamingQuery:
    """ods_db to fact topics and dimension tables; the configuration at `routes` is read anew for each batch: the routes
    themselves, or, where the folder has a column op, their changes in order of seq. Changes that have a time, `ts` in
    milliseconds, route each row as they stood at its own `ts`, so early rows keep the route they had."""

    def each(batch: DataFrame, number: int) -> None:
        ordered = binlog.etl_binlog(batch.withColumn("seq", F.monotonically_increasing_id()))
        known = spark.read.parquet(routes)
        if "op" in known.columns and "ts" in known.columns:
            routed = binlog.route_as_of(ordered, known, keep=["seq"])
        else:
            routed = binlog.route(ordered, binlog.merged_routes(known) if "op" in known.columns else known, ["seq"])
        routed = routed.persist()
        write_routed(binlog.to_topics(routed), root, number)
        # A row a dimension table of the configuration.
        tables = binlog.to_dimensions(routed).groupBy("sink_table").agg(F.max("sink_pk").alias("pk"), F.max("sink_extend").alias("extend"), F.array_distinct(F.flatten(F.collect_set(F.map_keys("data")))).alias("names"))
        for r in tables.collect():
            rows = binlog.to_dimensions(routed).filter(F.col("sink_table") == r.sink_table)
            rows = rows.select("seq", *(F.col("data")[c].alias(c) for c in r.names))
            table = UpsertTable(spark, f"{root}/dims/{r.sink_table}", (r.pk or "id").split(","), as_text=True, buckets=buckets_of(r.extend), keep_seconds=KEEP_SECONDS)
            table.upsert(rows, "seq", number)
        routed.unpersist()

    return run_stream(binlog.parse_binlog(read_topic(spark, root, TOPICS["db"], True)), each, f"{root}/_checkpoints/route_changes", available_now=available_now)


def wide_orders(spark: SparkSession, root: str) -> DataFrame:
    """The stream of order rows with their details."""
    o = typed(read_topic(spark, root, TOPICS["order_info"], True), ORDER_INFO)
    d = typed(read_topic(spark, root, TOPICS["order_detail"], True), ORDER_DETAIL)
    return orders.order_wide(o, d)


def wide_provinces(spark: SparkSession, root: str) -> DataFrame:
    """The order-wide topic with the columns that province statistics read, a stream."""
    schema = "province_id bigint, province_name string, province_area_code string, province_iso_code string, province_3166_2_code string, order_id bigint, split_total_amount decimal(20,2), create_time string"
    at = event_time(to_ms(F.col("create_time")))
    rows = as_table(read_topic(spark, root, TOPICS["order_wide"], True), schema, "order_wide", at, DELAYS["province"])
    return rows.withColumnsRenamed({"province_area_code": "area_code", "province_iso_code": "iso_code", "province_3166_2_code": "iso_3166_2"})


def keep_province_stats(spark: SparkSession, root: str, provinces: DataFrame | None = None, window: str = "5 seconds", available_now: bool = False, stamped: bool = False) -> StreamingQuery:
    """The order-wide topic to the province table; windows are written once, when they close. stamped: ts is the time of
    writing. With provinces given, orders and details are joined here and take those names instead."""
    wide = wide_orders(spark, root).join(provinces, "province_id", "left") if provinces is not None else wide_provinces(spark, root)
    out = stats.province_stats(wide, window)

    def each(batch: DataFrame, number: int) -> None:
        write_table(batch.withColumn("ts", F.unix_millis(F.current_timestamp())) if stamped else batch, root, RESULTS["province"], batch=number)

    return run_stream(out, each, f"{root}/_checkpoints/province", available_now=available_now)


def keep_keyword_stats(spark: SparkSession, root: str, window: str = "5 seconds", available_now: bool = False) -> StreamingQuery:
    """Search words of the page topic to the keyword table."""
    p = logs.parse_log(read_topic(spark, root, TOPICS["page"], True))
    rows = p.select(F.col("page")["item"].alias("item"), F.col("page")["page_id"].alias("page_id"), event_time(F.col("ts"), seconds=True).alias("et")).withWatermark("et", DELAYS["keyword"])
    return run_stream(stats.keyword_stats(rows, window), lambda batch, number: write_table(batch, root, RESULTS["keyword"], batch=number), f"{root}/_checkpoints/keyword", available_now=available_now)


def _to_topic(values: DataFrame, root: str, name: str, available_now: bool) -> StreamingQuery:
    """A stream of (value) to a topic, each batch in a folder that it replaces if it runs again."""
    return run_stream(values, lambda batch, number: write_lines(batch.select("value"), root, name, number), f"{root}/_checkpoints/{name}", available_now=available_now)


def visited(topic: DataFrame) -> DataFrame:
    """Rows of the page topic that have a visitor and a time: (mid, ts, last_page_id, body)."""
    page = logs.parsed_once(topic, f"common {MAP}, page {MAP}, ts bigint")
    rows = page.select(F.col("common")["mid"].alias("mid"), "ts", F.col("page")["last_page_id"].alias("last_page_id"), F.col("value").alias("body"))
    return rows.filter("mid IS NOT NULL AND ts IS NOT NULL")


def keep_unique_visitors(spark: SparkSession, root: str, available_now: bool = False) -> StreamingQuery:
    """A visitor's first page of a day to its topic, whole."""
    pages = visited(read_topic(spark, root, TOPICS["page"], True))
    pages = pages.withColumns({"arrival": F.lit(None).cast("bigint"), "entry": visits.is_entry(F.col("last_page_id"))})
    found = process(pages, UniqueVisitorProcessor(), DELAYS["default"])
    return _to_topic(found.select(F.col("body").alias("value")), root, TOPICS["unique_visitor"], available_now)


def keep_bounces(spark: SparkSession, root: str, variant: str = "v2", available_now: bool = False) -> StreamingQuery:
    """Entries that no page follows to their topic, whole. Each row waits for what follows it, and most for a batch only, so rows wait in
    files, and a batch is decided as a whole by the batch operator."""
    waiting = OpenRows(spark, f"{root}/_open/{TOPICS['bounce']}", BOUNCE_WITHIN_MS[variant], DELAY_MS["bounce"])

    def each(batch: DataFrame, number: int) -> None:
        write = lambda pending, due: write_lines(visits.bounces(pending, variant).filter(due).select(F.col("body").alias("value")), root, TOPICS["bounce"], number)
        waiting.take(visited(batch), number, write)

    return run_stream(read_topic(spark, root, TOPICS["page"], True), each, f"{root}/_checkpoints/{TOPICS['bounce']}", available_now=available_now)


#: Dimension tables by what they hold, with the columns that are read of them.
DIMENSIONS = {
    "user": ("dim_user_info", "id birthday gender"), "province": ("dim_base_province", "id name area_code iso_code iso_3166_2"), "sku": ("dim_sku_info", "id sku_name spu_id tm_id category3_id price"),
    "spu": ("dim_spu_info", "id spu_name"), "brand": ("dim_base_trademark", "id tm_name"), "category": ("dim_base_category3", "id name"),
}


def dimension(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A dimension as it is now; empty where nothing was written yet, null in columns that no row has had."""
    table, columns = DIMENSIONS[name]
    held = UpsertTable(spark, f"{root}/dims/{table}", ["id"], as_text=True)
    if not held.exists():
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns.split()))
    rows = held.read()
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns.split()))


def keep_order_wide(spark: SparkSession, root: str, as_of: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Orders with their details and the six look-ups, which are read anew for each batch, to their topic."""

    def each(batch: DataFrame, number: int) -> None:
        day = F.lit(as_of).cast("date") if as_of else F.current_date()
        specs = orders.order_dims(*(dimension(spark, root, n) for n in ("user", "province", "sku", "spu", "brand", "category")), day)
        write_topic(join_dims(batch, specs).drop("et"), root, TOPICS["order_wide"], number)

    return run_stream(wide_orders(spark, root), each, f"{root}/_checkpoints/order_wide", available_now=available_now)


WIDE = f"detail_id bigint, {ORDER_DETAIL.replace('id bigint, order_id', 'order_id', 1)}, province_id bigint, user_id bigint, total_amount decimal(20,2), order_status string, spu_name string, tm_name string, category3_name string"


def keep_payment_wide(spark: SparkSession, root: str, available_now: bool = False) -> StreamingQuery:
    """Payments with their wide orders to their topic."""
    paid = typed(read_topic(spark, root, TOPICS["payment_info"], True), PAYMENT_INFO)
    wide = typed(read_topic(spark, root, TOPICS["order_wide"], True), WIDE)
    out = orders.payment_wide(paid, wide.drop("create_date", "create_hour", "create_ts")).drop("et")
    return _to_topic(as_json(out), root, TOPICS["payment_wide"], available_now)


def _page_metrics(topic: DataFrame) -> DataFrame:
    """A topic of page documents with the columns that visitor statistics read."""
    page = logs.parse_log(topic)
    common = [F.col("common")[c].alias(c) for c in stats.VISITOR_DIMS]
    rows = page.select(event_time(F.col("ts")).alias("et"), *common, F.col("page")["during_time"].cast("bigint").alias("during_time"), F.col("page")["last_page_id"].alias("last_page_id"))
    return rows.withWatermark("et", DELAYS["visitor"])


def keep_visitor_stats(spark: SparkSession, root: str, window: str = "5 seconds", available_now: bool = False) -> StreamingQuery:
    """Pages, unique visitors and bounces to the visitor table."""
    read = read_topics(spark, root, [TOPICS[n] for n in ("page", "unique_visitor", "bounce")], True)
    out = stats.visitor_stats(*map(_page_metrics, read.values()), window)
    return run_stream(out, lambda batch, number: write_table(batch, root, RESULTS["visitor"], batch=number), f"{root}/_checkpoints/visitor", available_now=available_now)


def keep_counts(spark: SparkSession, root: str, topic: str, fields: dict[str, str], table: UpsertTable, available_now: bool = False) -> StreamingQuery:
    """Running counts of a topic's rows by fields (name -> JSON path) in a keyed table, whose keys they are: the table is the
    state, and a batch that runs again adds nothing."""
    rows = read_topic(spark, root, topic, True).select(*(F.get_json_object("value", path).alias(name) for name, path in fields.items()), F.lit(1).cast("bigint").alias("ct"))
    return run_stream(rows, lambda batch, number: table.add(batch, ["ct"], number), f"{root}/_checkpoints/counts_{topic}", available_now=available_now)


def product_dims(spark: SparkSession, root: str) -> list[DimSpec]:
    """A product's look-ups, with its price; the last three by keys that the sku gives."""
    number = lambda c: F.col(c).cast("bigint")
    return [
        DimSpec(dimension(spark, root, "sku"), "sku_id", {"sku_name": "sku_name", "sku_price": F.col("price").cast(stats.MONEY), "spu_id": number("spu_id"), "tm_id": number("tm_id"), "category3_id": number("category3_id")}),
        DimSpec(dimension(spark, root, "spu"), "spu_id", {"spu_name": "spu_name"}),
        DimSpec(dimension(spark, root, "brand"), "tm_id", {"tm_name": "tm_name"}),
        DimSpec(dimension(spark, root, "category"), "category3_id", {"category3_name": "name"}),
    ]


def _product_sources(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    def topic(name: str, schema: str, time: str = "create_time") -> DataFrame:
        rows = read_topic(spark, root, TOPICS[name], True).select(F.from_json("value", schema).alias("r")).select("r.*")
        at = F.col("ts") if time == "ts" else to_ms(F.col(time))
        return rows.withColumn("et", event_time(at)).withWatermark("et", DELAYS["default"])

    page = topic("page", LOG, "ts").select("et", F.col("page")["page_id"].alias("page_id"), F.col("page")["item"].alias("item"))
    return {
        "display": topic("display", "item string, item_type string, ts bigint", "ts"), "click": page, "favor": topic("favor_info", FAVOR_INFO), "cart": topic("cart_info", CART_INFO),
        "order": topic("order_wide", WIDE), "payment": topic("payment_wide", f"{WIDE}, payment_create_time string", "payment_create_time"),
        "refund": topic("refund_info", REFUND_INFO), "comment": topic("comment_info", COMMENT_INFO),
    }


def keep_product_stats(spark: SparkSession, root: str, window: str = "5 seconds", available_now: bool = False) -> StreamingQuery:
    """The eight product topics, with the product's look-ups, to the product table and its topic."""

    def each(batch: DataFrame, number: int) -> None:
        rows = join_dims(batch, product_dims(spark, root)).persist()
        write_table(rows, root, RESULTS["product"], batch=number)
        write_topic(rows, root, TOPICS["product_stats"], number)
        rows.unpersist()

    out = stats.product_stats(_product_sources(spark, root), window)
    return run_stream(out, each, f"{root}/_checkpoints/product", available_now=available_now)


def keyword_products(spark: SparkSession, root: str) -> UpsertTable:
    """Counts of product words: a row for each (stt, edt, keyword, source)."""
    return UpsertTable(spark, f"{root}/{RESULTS['keyword']}_products", ["stt", "edt", "keyword", "source"], keep_seconds=KEEP_SECONDS)


def keep_keyword_products(spark: SparkSession, root: str, available_now: bool = False) -> StreamingQuery:
    """Clicks, orders and cart additions of the product topic by word. A word's row is one by its key, in whatever batches its
    counts arrive: they are added to what the table holds, and what a batch changed goes to the topic of changes, the old row as '-U'
    and the new one as '+U', so sums over that topic stay right."""
    table = keyword_products(spark, root)

    def each(batch: DataFrame, number: int) -> None:
        table.add(stats.keyword_product_stats(batch), ["ct"], number)
        if table.exists():
            write_topic(table.changes_of(number), root, TOPICS["keyword_changes"], number)

    rows = read_topic(spark, root, TOPICS["product_stats"], True).select(F.from_json("value", "stt string, edt string, spu_name string, click_ct bigint, order_ct bigint, cart_ct bigint").alias("r")).select("r.*")
    return run_stream(rows, each, f"{root}/_checkpoints/keyword_products", available_now=available_now)
