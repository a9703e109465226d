"""Queries that run the stream jobs and the sinks over topics made of the sample tables, so that what they leave behind can be
held against SQL. A topic ends with a row of a later day, which closes what is before it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RESULTS, TOPICS
from ..operators import logs, orders
from ..operators.dims import DimSpec, join_dims
from ..sources.sinks import UpsertTable, as_json, insert_select, read_routed, read_table
from ..sources.topics import MAX_FILES, read_topic
from ..streaming import jobs
from ..streaming.processors import configure
from .samples import DAY, MONEY, Samples, as_logs

#: The visitor of the closing rows, and how far they are behind all others.
LAST, LATER_MS = "zz", 3 * 86_400_000


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or the warehouse; on a local master without one, a
    temporary folder that goes at exit."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.startswith("local["):
        path = tempfile.mkdtemp(prefix="millrace-streams-")
        atexit.register(shutil.rmtree, path, True)
        return path
    return f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/millrace-streams/{uuid.uuid4().hex}"


def as_pages(p: DataFrame) -> DataFrame:
    """Pages as rows of their topic."""
    page = F.struct("page_id", "item", "last_page_id", F.col("during_time").cast("string").alias("during_time"))
    return p.select(F.struct("mid", "vc", "ch", "ar", "is_new").alias("common"), page.alias("page"), "ts", "arrival")


class Topics:
    """A root with topics made of the samples."""

    def __init__(self, s: Samples):
        self.s, self.spark, self.root = s, s.spark, scratch(s.spark)
        configure(self.spark)

    def put(self, rows: DataFrame, name: str, closing: DataFrame | None = None, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Rows with ts and arrival, in that order, as documents of the columns left when they have their shape, which they take behind
        the exchange; then the closing ones."""
        ordered = shape(rows.repartition(self.cores(), "ts").sortWithinPartitions("ts", "arrival")).drop("arrival")
        as_json(ordered).write.mode("append").text(f"{self.root}/{name}")
        if closing is not None:
            as_json(closing).write.mode("append").text(f"{self.root}/{name}")

    def cores(self) -> int:
        """As many files or partitions as cores; rows of one time are in one file, in order of arrival."""
        return min(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def run(self, job: Callable, *args, stores: bool = True, **more) -> None:
        """A job to the end of what is there, with no more partitions than cores where each has a state store that is opened and
        committed in every batch. Files of a topic aren't in order of time, so all that a batch should have is taken up with it: rows
        of files that are left for the next one would be late."""
        conf = self.spark.conf
        own = {MAX_FILES: str(self.files_a_batch())} | ({"spark.sql.shuffle.partitions": str(self.cores())} if stores else {})
        before = {k: conf.get(k, None) for k in own}
        try:
            for k, v in own.items():
                conf.set(k, v)
            job(self.spark, self.root, *args, available_now=True, **more).awaitTermination()
        finally:
            for k, v in before.items():
                conf.set(k, v) if v is not None else conf.unset(k)

    def files_a_batch(self) -> int:
        return 2**31 - 1

    def pages(self, of: Callable[[DataFrame], DataFrame] = lambda p: p) -> None:
        """The page topic, of pages with their marks."""
        self.put(of(self.s.pages), TOPICS["page"], self.closing(), as_pages)

    def closing(self) -> DataFrame:
        end = self.s.pages.agg((F.max("ts") + LATER_MS).alias("ts"))
        common = F.create_map(*(x for c in ("mid", "vc", "ch", "ar", "is_new") for x in (F.lit(c), F.lit(LAST))))
        page = F.create_map(F.lit("page_id"), F.lit("good_list"), F.lit("item"), F.lit(LAST), F.lit("last_page_id"), F.lit("x"))
        return end.select(common.alias("common"), page.alias("page"), "ts")

    def rows(self, name: str) -> DataFrame:
        """A topic's pages: mid, ts, is_new."""
        r = read_topic(self.spark, self.root, name).select(F.from_json("value", "common map<string,string>, ts bigint").alias("r"))
        return r.select(F.col("r.common")["mid"].alias("mid"), F.col("r.ts").alias("ts"), F.col("r.common")["is_new"].alias("is_new")).filter(F.col("mid") != LAST)

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.root, RESULTS[name]).drop("dt", "batch")


def _split(s: Samples) -> DataFrame:
    """Logs through repair and split to the page topic."""
    t = Topics(s)
    t.put(s.pages, TOPICS["log"], t.closing(), as_logs)
    t.run(jobs.split_logs)
    return t.rows(TOPICS["page"])


def _visits(s: Samples, name: str, job: Callable) -> DataFrame:
    t = Topics(s)
    t.pages()
    t.run(job)
    return t.rows(TOPICS[name]).drop("is_new")


def _visitors(s: Samples) -> DataFrame:
    """Pages to unique visitors and bounces, and all three to the visitor table by the hour."""
    t = Topics(s)
    t.pages(logs.repair_is_new)
    for name, job in (("unique_visitor", jobs.keep_unique_visitors), ("bounce", jobs.keep_bounces)):
        t.run(job)
        as_json(t.closing()).write.mode("append").text(f"{t.root}/{TOPICS[name]}/batch=999")
    t.run(jobs.keep_visitor_stats, "1 hour")
    return t.table("visitor").filter(F.col("vc") != LAST)


def _keywords(s: Samples) -> DataFrame:
    t = Topics(s)
    t.pages(lambda p: p.withColumn("page_id", F.when(F.col("page_id") == "view", "good_list").otherwise("other")))
    t.run(jobs.keep_keyword_stats, "1 day")
    return t.table("keyword")


def _routed(s: Samples) -> DataFrame:
    """Changes through their routes: rows of the fact topic and of the dimension table."""
    t = Topics(s)
    key = {"n_nationkey": "n_nationkey"}
    s.routes.fillna(key["n_nationkey"], ["sink_pk"]).write.parquet(f"{t.root}/routes")
    t.put(s.changes.select("*", F.lit(0).alias("ts"), F.monotonically_increasing_id().alias("arrival")), TOPICS["db"])
    jobs.route_changes(t.spark, t.root, f"{t.root}/routes", available_now=True).awaitTermination()
    facts = read_routed(t.spark, t.root, "dwd_nation").select(F.from_json("value", "n_nationkey string, n_name string").alias("r"))
    facts = facts.select(F.lit("dwd_nation").alias("sink_table"), F.col("r.n_nationkey").alias("n_nationkey"), F.col("r.n_name").alias("n_name"))
    held = UpsertTable(t.spark, f"{t.root}/dims/dim_nation", list(key), as_text=True).read()
    return facts.unionByName(held.select(F.lit("dim_nation").alias("sink_table"), "n_nationkey", F.lit(None).cast("string").alias("n_name")))


def _upserted(s: Samples) -> DataFrame:
    """Three batches of pages in order of arrival into a keyed table."""
    table = UpsertTable(s.spark, f"{scratch(s.spark)}/visitors", ["mid"])
    p = s.pages.select("mid", "page_id", "arrival")
    most = p.agg(F.max("arrival")).first()[0] or 0
    for k in range(3):
        table.upsert(p.filter((F.col("arrival") * 3 > most * k - (k == 0)) & (F.col("arrival") * 3 <= most * (k + 1))), "arrival")
    return table.read()


def _inserted(s: Samples) -> DataFrame:
    """INSERT INTO a result table from a query over a view."""
    name = f"millrace_inserted_{uuid.uuid4().hex}"
    s.spark.sql(f"CREATE TABLE {name} (page_id STRING, visits BIGINT) USING parquet LOCATION '{scratch(s.spark)}/inserted'")
    insert_select(s.pages, "millrace_pages", name, "SELECT page_id, count(*) FROM millrace_pages GROUP BY page_id")
    return s.spark.table(name)


def _snowflake(s: Samples) -> DataFrame:
    """Wide orders with all six look-ups, three of them by keys that the product gives."""
    part, customer, nation = s.table("part"), s.table("customer"), s.table("nation")
    brand = F.regexp_replace("p_brand", "[^0-9]", "")
    users = customer.select(F.col("c_custkey").alias("id"), F.date_add(F.lit("1990-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int")).alias("birthday"), F.col("c_mktsegment").alias("gender"))
    provinces = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("area_code"), F.col("n_name").alias("iso_code"), F.col("n_name").alias("iso_3166_2"))
    skus = part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 2).alias("spu_id"), brand.alias("tm_id"), F.col("p_size").alias("category3_id"))
    spus = part.select((F.col("p_partkey") * 2).alias("id"), F.col("p_name").alias("spu_name"))
    brands = part.select(brand.alias("id"), F.col("p_brand").alias("tm_name")).distinct()
    categories = part.select(F.col("p_size").alias("id"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("name")).distinct()
    specs = orders.order_dims(users, provinces, skus, spus, brands, categories, F.lit("2021-05-28").cast("date"))
    wide = orders.widen(s.orders, s.details, specs, "5 days", "5 days")
    return wide.select("detail_id", "order_id", "user_age", "user_gender", "province_name", "spu_id", "spu_name", "tm_id", "tm_name", "category3_id", "category3_name")


def _priced(s: Samples) -> DataFrame:
    """A day's products with their price."""
    price = DimSpec(s.table("part"), "sku_id", {"sku_price": F.col("p_retailprice").cast(MONEY)}, "p_partkey")
    return join_dims(s.products(DAY), [price]).select("sku_id", "spu_name", "sku_price", "order_amount", "order_ct")


def _of(build: Callable[[Samples], DataFrame]):
    return lambda spark, root: build(Samples(spark, root))


QUERIES = {
    "stream_split_logs": _of(_split),
    "stream_unique_visitors": _of(lambda s: _visits(s, "unique_visitor", jobs.keep_unique_visitors)),
    "stream_bounces_v1": _of(lambda s: _visits(s, "bounce", lambda spark, root, available_now: jobs.keep_bounces(spark, root, "v1", available_now))),
    "stream_bounces_v2": _of(lambda s: _visits(s, "bounce", jobs.keep_bounces)),
    "stream_visitor_stats": _of(_visitors),
    "stream_keyword_stats": _of(_keywords),
    "stream_routes": _of(_routed),
    "upsert_table": _of(_upserted),
    "insert_select": _of(_inserted),
    "order_wide_six_dims": _of(_snowflake),
    "product_prices": _of(_priced),
}
