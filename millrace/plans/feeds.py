"""Queries on what streams leave behind when batches run again, rows come late, routes and dimensions change, and counts arrive in
parts; with their SQL. Topics are made of the samples in several files, one a batch."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DATETIME, TOPICS
from ..functions.segment import dictionary_tokens, segmenter_of
from ..functions.time import from_ms
from ..operators import binlog, stats
from ..operators.dims import DimSpec, join_dims, versions_of
from ..sources import files
from ..sources.sinks import OpenWindows, ResultTable, UpsertTable, as_json
from ..sources.topics import read_topic
from ..streaming import jobs
from . import serving
from .oracles import ITEMS, MONEY, ORACLES, PAGES, REPAIRED, bounced, stamp
from .samples import DAY, EVENT_DAY, Samples, as_logs
from .streams import LAST, LATER_MS, Topics, as_pages, scratch

DAY_MS = 86_400_000
#: DELAYS["default"].
DELAY_MS = 5_000


class Fed(Topics):
    """Topics whose parts are put one after the other, and read one a batch. A part is as many files as there are cores."""

    def put_parts(self, rows: DataFrame, name: str, parts: Column, count: int, **shape: Callable[[DataFrame], DataFrame]) -> None:
        """Rows with ts and arrival in `count` parts: the number `parts` says which."""
        numbered = rows.withColumn("__part", parts)
        for k in range(count):
            self.put_part(numbered.filter(F.col("__part") == k).drop("__part"), name, **shape)

    def put_part(self, rows: DataFrame, name: str, **shape: Callable[[DataFrame], DataFrame]) -> None:
        """A part, sorted by (ts, arrival); tasks without rows write no file, so empty ones make up the number."""
        at = f"{self.root}/{name}"
        written = lambda: sum(n.startswith("part-") for n in files.names(self.spark, at))
        before = written()
        self.put(rows, name, **shape)
        for k in range(written() - before, self.cores()):
            files.mark(self.spark, f"{at}/part-none-{before + k}")

    def put_one(self, rows: DataFrame, name: str) -> None:
        """A few rows in one file."""
        as_json(rows.coalesce(1)).write.mode("append").text(f"{self.root}/{name}")

    def files_a_batch(self) -> int:
        return self.cores()

    def forget_commit(self, checkpoint: str) -> int:
        """As if the job had been killed at the end of its last batch: Spark doesn't know that it ended. Its number."""
        at = f"{self.root}/_checkpoints/{checkpoint}/commits"
        last = max(int(n) for n in files.names(self.spark, at) if n.isdigit())
        files.delete(self.spark, f"{at}/{last}")
        return last


def thirds(column: str, rows: DataFrame) -> Column:
    """0, 1 or 2 by the place of a row in the range of a number."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    return F.least(F.lit(2), F.floor((F.col(column) - F.lit(low or 0)) * 3 / F.lit(max(1, (high or 0) - (low or 0))))).cast("int")


def _committed(s: Samples) -> DataFrame:
    """Two jobs in a row: pages to a topic of their own, and a running count of that. The first is killed behind a commit that
    the second hasn't read yet, behind one that it has read, and ahead of one with half of it written."""
    t = Fed(s)
    p = s.pages
    part = thirds("arrival", p)
    counts = UpsertTable(t.spark, f"{t.root}/counts", ["mid", "page_id"])
    copy = lambda spark, root, available_now: jobs._to_topic(read_topic(spark, root, TOPICS["page"], True), root, "seen", available_now)
    count = lambda spark, root, available_now: jobs.keep_counts(spark, root, "seen", {"mid": "$.common.mid", "page_id": "$.page.page_id"}, counts, available_now)
    for k in range(3):
        t.put_part(p.withColumn("__part", part).filter(F.col("__part") == k).drop("__part"), TOPICS["page"], shape=as_pages)
        t.run(copy)
        if k == 0:
            t.forget_commit("seen")
            t.run(copy)
            t.run(count)
        elif k == 1:
            t.run(count)
            t.forget_commit("seen")
            t.forget_commit("counts_seen")
        else:
            last = t.forget_commit("seen")
            files.rename(t.spark, f"{t.root}/seen/batch={last}", f"{t.root}/seen/_staged-batch={last}")
    t.run(copy)
    t.run(count)
    return counts.read()


LATE_BY_MS = 2 * DAY_MS


def _dense_bounces(s: Samples, variant: str) -> DataFrame:
    """Bounces of pages so dense that visits follow each other within seconds; no two times of a visitor are equal."""
    t = Fed(s)
    p = s.pages.withColumn("ts", F.expr("(ts div 432000) * 100 + arrival % 100"))
    t.put_parts(p, TOPICS["page"], thirds("ts", p), 3, shape=as_pages)
    t.put_one(t.closing(), TOPICS["page"])
    t.run(jobs.keep_bounces, variant)
    return t.rows(TOPICS["bounce"]).drop("is_new")


def _dense_visitors(s: Samples) -> DataFrame:
    """Unique visitors of pages in several batches."""
    t = Fed(s)
    p = s.pages
    t.put_parts(p, TOPICS["page"], thirds("ts", p), 3, shape=as_pages)
    t.put_one(t.closing(), TOPICS["page"])
    t.run(jobs.keep_unique_visitors)
    return t.rows(TOPICS["unique_visitor"]).drop("is_new")


def _split_topics(s: Samples) -> DataFrame:
    """Logs through repair and split in several batches: rows of all three topics."""
    t = Fed(s)
    t.put_parts(s.pages, TOPICS["log"], thirds("ts", s.pages), 3, shape=as_logs)
    t.put_one(t.closing(), TOPICS["log"])
    t.run(jobs.split_logs)
    flat = "common map<string,string>, mid string, is_new string, ts string, item string"
    out = None
    for name in ("start", "page", "display"):
        r = read_topic(t.spark, t.root, TOPICS[name]).select(F.from_json("value", flat).alias("r")).select("r.*")
        rows = r.select(F.lit(name).alias("topic"), F.coalesce("mid", F.col("common")["mid"]).alias("mid"), F.expr("try_cast(ts AS bigint)").alias("ts"), F.coalesce("is_new", F.col("common")["is_new"]).alias("is_new"), (F.col("item") if name == "display" else F.lit(None).cast("string")).alias("item"))
        out = rows if out is None else out.unionByName(rows)
    return out.filter(F.col("mid") != LAST)


def _late_rows(s: Samples) -> DataFrame:
    """Words of searches by day. A tenth of the rows of all but the last days come with the last rows, when their windows are
    closed: they drop."""
    t = Fed(s)
    p = s.pages.withColumn("page_id", F.when(F.col("page_id") == "view", "good_list").otherwise("other"))
    cut = p.agg(F.max("ts")).first()[0] - 10 * DAY_MS
    late = (F.col("arrival") % 10 == 0) & (F.col("ts") < cut - LATE_BY_MS)
    # A batch's late rows go by the watermark of the batch before it.
    t.put_parts(p, TOPICS["page"], F.when(late, 2).when(F.col("ts") >= cut, 1 + F.col("arrival") % 2).otherwise(0), 3, shape=as_pages)
    t.put_one(t.closing(), TOPICS["page"])
    t.run(jobs.keep_keyword_stats, "1 day")
    return t.table("keyword")


def _product_words(s: Samples) -> tuple[Fed, UpsertTable]:
    """Clicks, orders and cart additions one by one, in three batches of which one runs again."""
    t = Fed(s)
    p = s.pages.filter(F.col("page_id").isin("click", "purchase", "signup"))
    day = F.date_trunc("day", "et")
    ct = {"click_ct": "click", "order_ct": "purchase", "cart_ct": "signup"}
    rows = p.select("ts", "arrival", F.date_format(day, DATETIME).alias("stt"), F.date_format(day + F.expr("interval 1 day"), DATETIME).alias("edt"), F.col("item").alias("spu_name"), *((F.col("page_id") == k).cast("int").alias(c) for c, k in ct.items()))
    t.put_parts(rows, TOPICS["product_stats"], (F.col("arrival") % 3).cast("int"), 3)
    t.run(jobs.keep_keyword_products)
    t.forget_commit("keyword_products")
    t.run(jobs.keep_keyword_products)
    return t, jobs.keyword_products(t.spark, t.root)


def _word_changes(s: Samples) -> DataFrame:
    """What a reader of the changes sums up to: old rows taken back, new ones taken up."""
    t, _ = _product_words(s)
    r = read_topic(t.spark, t.root, TOPICS["keyword_changes"]).select(F.from_json("value", "op string, stt string, edt string, keyword string, source string, ct bigint").alias("r")).select("r.*")
    sign = F.when(F.col("op").isin("-U", "-D"), -1).otherwise(1)
    return r.groupBy("stt", "edt", "keyword", "source").agg(F.sum(sign * F.col("ct")).alias("ct"), F.sum(sign).cast("bigint").alias("live"))


def _province_topic(s: Samples) -> DataFrame:
    """The order-wide topic to province statistics by day, in several batches, its orders counted once each."""
    t = Fed(s)
    names = {"area_code": "province_area_code", "iso_code": "province_iso_code", "iso_3166_2": "province_3166_2_code"}
    rows = s.order_facts.withColumnsRenamed(names).select("*", F.date_format("et", DATETIME).alias("create_time"), F.unix_millis("et").alias("ts"), F.monotonically_increasing_id().alias("arrival")).drop("et")
    t.put_parts(rows, TOPICS["order_wide"], thirds("ts", rows), 3)
    last = rows.agg((F.max("ts") + LATER_MS).alias("ts")).select(F.lit(-1).alias("province_id"), F.lit(0).alias("order_id"), from_ms(F.col("ts")).alias("create_time"))
    t.put_one(last, TOPICS["order_wide"])
    t.run(jobs.keep_province_stats, window="1 day")
    return t.table("province").filter("province_id >= 0").drop("ts", "iso_code", "iso_3166_2")


def _merged_days(s: Samples) -> DataFrame:
    """A result table of many batches whose days are merged: page views by day, kind and batch."""
    table = ResultTable(s.spark, f"{scratch(s.spark)}/views", most=3)
    p = s.pages.groupBy(F.date_format(F.date_trunc("day", "et"), DATETIME).alias("stt"), "page_id", (F.col("arrival") % 8).alias("k")).agg(F.count(F.lit(1)).alias("ct")).persist()
    for k in range(8):
        for _ in range(1 + k % 2):  # every second batch runs twice
            table.append(p.filter(F.col("k") == k).drop("k"), k)
    p.unpersist()
    assert all(n <= 4 for n in Counter(f.partition("/")[2] for f in table.folders()).values())
    return table.read().groupBy("dt", "page_id").agg(F.sum("ct").alias("ct"))


def _pinned(s: Samples) -> DataFrame:
    """A reader's pinned version of a table, read after six more upserts, beside the newest."""
    table = UpsertTable(s.spark, f"{scratch(s.spark)}/visitors", ["mid"], buckets=4)
    p = s.pages.select("mid", "page_id", "arrival")
    most = p.agg(F.max("arrival")).first()[0] or 0
    for k in range(7):
        table.upsert(p.filter((F.col("arrival") * 7 > most * k - (k == 0)) & (F.col("arrival") * 7 <= most * (k + 1))), "arrival")
        if k == 0:
            held = table.pin("report")
    return table.read(held).withColumn("at", F.lit("pinned")).unionByName(table.read().withColumn("at", F.lit("newest")))


def _routes_as_of(s: Samples) -> DataFrame:
    """Order changes in order of their dates while the configuration changes: first to one topic, from 1994 on with other columns to
    another, in 1996 to none, from 1997 to a dimension table."""
    o = s.table("orders")
    ts = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    data = F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("status"), F.col("o_orderstatus"), F.lit("clerk"), F.lit("x"))
    changes = o.select(F.lit("shop").alias("database"), F.lit("orders").alias("table"), F.when(F.col("o_orderkey") % 2 == 0, "insert").otherwise("bootstrap-insert").alias("type"), ts.alias("ts"), data.alias("data"))
    year = lambda y: F.unix_millis(F.to_timestamp(F.lit(f"{y}-01-01")))
    columns = "sourceTable string, operateType string, sinkType string, sinkTable string, sinkColumns string, sinkPk string, sinkExtend string, op string, seq int, y int"
    rows = [("+I", "kafka", "early", "id,status", 1970), ("-U", "kafka", "early", "id,status", 1994), ("+U", "kafka", "late", "id", 1994), ("-D", "kafka", "late", "id", 1996), ("+I", "hbase", "dim_orders", "id", 1997)]
    config = s.spark.createDataFrame([("orders", "insert", kind, table, names, "id", None, op, k, y) for k, (op, kind, table, names, y) in enumerate(rows)], columns)
    at = F.col("y")
    config = config.withColumn("ts", F.coalesce(*(F.when(at == y, year(y)) for y in (1970, 1994, 1996, 1997)))).drop("y")
    routed = binlog.route_as_of(binlog.etl_binlog(changes), config)
    return routed.select("sink_type", "sink_table", F.col("data")["id"].alias("id"), F.col("data")["status"].alias("status"))


def _as_of_wide(s: Samples) -> DataFrame:
    """Orders with the name of their customer's segment as it was at the time of the order: all segments are renamed in 1995."""
    c = s.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    renamed = c.withColumn("segment", F.lower("segment")).withColumns({"ts": F.to_timestamp(F.lit("1995-06-17")), "seq": F.lit(2)})
    log = c.withColumns({"ts": F.to_timestamp(F.lit("1970-01-01")), "seq": F.lit(1)}).unionByName(renamed)
    spec = DimSpec(versions_of(log, ["id"]), "user_id", {"segment": "segment"}, at="et")
    return join_dims(s.orders.select(F.col("id").alias("order_id"), "user_id", "et"), [spec]).select("order_id", "segment")


#: Twenty-six characters that stand for the letters a to z.
GLYPHS = "".join(chr(0x4E00 + k) for k in range(26))
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _segmented(s: Samples) -> DataFrame:
    """Names written in characters and without spaces, in words of a dictionary of their words."""
    glyphs = lambda c: F.translate(F.lower(c), LETTERS, GLYPHS)
    words = s.table("part").select(F.explode(F.split(glyphs("p_name"), " ")).alias("word"))
    segmenter = segmenter_of(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    text = F.concat(F.lit("No."), F.col("p_partkey").cast("string"), F.regexp_replace(glyphs("p_name"), " ", ""), F.lit("!"))
    return s.table("part").select("p_partkey", F.array_join(dictionary_tokens(text, segmenter), " ").alias("words"))


def _product_orders(s: Samples) -> DataFrame:
    """Order lines on a stream, in several batches, to products by day: each order counts once for a product. Nearly every line is a
    key of its own, so lines of open days wait in files, and a day is summed when it closes."""
    t = Fed(s)
    d = s.details.select("order_id", "sku_id", "sku_num", "split_total_amount", "create_time", "status", F.unix_millis("et").alias("ts"), F.col("id").alias("arrival"))
    t.put_parts(d, "lines", thirds("ts", d), 3)
    last = d.agg((F.max("ts") + LATER_MS).alias("ts")).select(F.lit(-1).alias("sku_id"), from_ms(F.col("ts")).alias("create_time"))
    t.put_one(last, "lines")
    table = ResultTable(t.spark, f"{t.root}/products", None)  # thousands of days a batch, none asked for
    lines = OpenWindows(t.spark, f"{t.root}/open_lines", "1 day", DELAY_MS)

    def each(batch: DataFrame, number: int) -> None:
        rows = jobs.typed(batch, f"order_id bigint, sku_id bigint, sku_num bigint, split_total_amount {MONEY}, status string, create_time string")
        paid = F.col("status") == "F"
        row = stats.product_row(rows, order_id=F.col("order_id"), ordered=F.lit(1), paid=paid, order_sku_num=F.col("sku_num"), order_amount=F.col("split_total_amount"))
        lines.take(row, number, lambda closed: table.append(stats.product_windows(closed, "1 day"), number))

    def job(spark: SparkSession, root: str, available_now: bool):
        return jobs.run_stream(read_topic(spark, root, "lines", True), each, f"{root}/_checkpoints/products", available_now=available_now)

    t.run(job, stores=False)
    return table.read().filter("sku_id >= 0").select("stt", "sku_id", "order_sku_num", "order_amount", "order_ct", "paid_order_ct")


def _answers(s: Samples) -> DataFrame:
    """What the dashboard's endpoints answer, taken out of their envelopes: (endpoint, name, value)."""
    tables = {"product": s.products(DAY), "province": stats.province_stats(s.province_facts, "1 day", names=s.province_names), "visitor": s.visitor_table(EVENT_DAY), "keyword": s.keyword_table}
    rows = []
    for endpoint in serving.ENDPOINTS:
        answer = json.loads(serving.serve(endpoint, tables, EVENT_DAY if endpoint in ("visitor", "visitor_is_new", "kw") else DAY))
        assert answer["status"] == 0
        rows += [(endpoint, *x) for x in entries(answer["data"])]
    return s.spark.createDataFrame(rows, "endpoint string, name string, value double")


def entries(data) -> list[tuple[str, float]]:
    """(name, value) of an envelope's data, of any shape that there is."""
    if isinstance(data, list):
        return [(str(x["name"]), float(x["value"])) for x in data]
    if not isinstance(data, dict):
        return [("all", float(data))]
    if "mapData" in data:
        return entries(data["mapData"])
    if "categories" in data:
        return [(f"{c} {x['name']}", float(v)) for x in data["series"] for c, v in zip(data["categories"], x["data"], strict=True)]
    first, *rest = (c["id"] for c in data["columns"])
    return [(f"{r[first]} {c}", float(r[c])) for r in data["rows"] for c in rest]


def _product_look_ups(s: Samples) -> DataFrame:
    """Products of a day with their look-ups as the product job has them, three of them by keys that the first one gives; from keyed
    tables of text, as routes fill them."""
    part, root = s.table("part"), scratch(s.spark)
    brand = F.regexp_replace("p_brand", "[^0-9]", "")
    held = {
        "sku": part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("sku_name"), (F.col("p_partkey") * 2).alias("spu_id"), brand.alias("tm_id"), F.col("p_size").alias("category3_id"), F.col("p_retailprice").cast(MONEY).alias("price")),
        "spu": part.filter("p_partkey % 5 > 0").select((F.col("p_partkey") * 2).alias("id"), F.upper("p_name").alias("spu_name")),
        "brand": part.select(brand.alias("id"), F.col("p_brand").alias("tm_name")).distinct(),
        "category": part.select(F.col("p_size").alias("id"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("name")).distinct(),
    }
    for name, rows in held.items():
        UpsertTable(s.spark, f"{root}/dims/{jobs.DIMENSIONS[name][0]}", ["id"], as_text=True, buckets=4).upsert(rows.withColumn("seq", F.lit(1)), "seq")
    sold = stats.product_stats({"order": s.details_on(DAY)}, "1 day")
    return join_dims(sold, jobs.product_dims(s.spark, root)).select("sku_id", "order_ct", "order_amount", "sku_name", "sku_price", "spu_name", "tm_name", "category3_name")


def _of(build: Callable[[Samples], DataFrame]):
    return lambda spark, root: build(Samples(spark, root))


QUERIES = {
    "stream_committed_topics": _of(_committed),
    "stream_bounces_v1_dense": _of(lambda s: _dense_bounces(s, "v1")),
    "stream_bounces_v2_dense": _of(lambda s: _dense_bounces(s, "v2")),
    "stream_unique_visitors_batches": _of(_dense_visitors),
    "stream_split_topics": _of(_split_topics),
    "stream_late_rows": _of(_late_rows),
    "stream_product_words": _of(lambda s: _product_words(s)[1].read()),
    "stream_product_word_changes": _of(_word_changes),
    "stream_province_topic": _of(_province_topic),
    "stream_product_orders": _of(_product_orders),
    "result_days_merged": _of(_merged_days),
    "upsert_pinned": _of(_pinned),
    "routes_as_of": _of(_routes_as_of),
    "order_segments_as_of": _of(_as_of_wide),
    "segmented_names": _of(_segmented),
    "dashboard_answers": _of(_answers),
    "product_look_ups": _of(_product_look_ups),
}

_DENSE = f"{PAGES}, dense AS (SELECT * REPLACE ((ts // 432000) * 100 + arrival % 100 AS ts) FROM pages)"

_LATE = PAGES.replace("FROM events)", f"FROM events WHERE NOT (event_id % 10 = 0 AND epoch_us(ts) // 1000 < (SELECT max(epoch_us(ts) // 1000) FROM events) - {10 * DAY_MS + LATE_BY_MS}))")

_WORDS = ORACLES["keyword_product_stats"]


def _answer(endpoint: str, query: str, name: str, value: str) -> str:
    return f"SELECT '{endpoint}' AS endpoint, {name} AS name, CAST({value} AS DOUBLE) AS value FROM ({ORACLES[query]})"


ORACLE_SQL = {
    "stream_committed_topics": f"WITH {PAGES} SELECT mid, page_id, count(*) AS ct FROM pages GROUP BY 1, 2",
    "stream_bounces_v1_dense": f"WITH {_DENSE} SELECT mid, ts FROM ({bounced('dense', 'v1')})".replace("21600000", "20000"),
    "stream_bounces_v2_dense": f"WITH {_DENSE} SELECT mid, ts FROM ({bounced('dense', 'v2')})".replace("21600000", "5000"),
    "stream_unique_visitors_batches": f"SELECT mid, ts FROM ({ORACLES['unique_visitors']})",
    "stream_split_topics": f"""WITH {REPAIRED} SELECT 'start' AS topic, mid, ts, is_new, NULL AS item FROM repaired WHERE page_id = 'signup'
        UNION ALL SELECT 'page', mid, ts, is_new, NULL FROM repaired WHERE page_id NOT IN ('signup', 'error')
        UNION ALL SELECT 'display', mid, NULL, is_new, i FROM repaired, (VALUES ('0'), ('1')) v(i) WHERE page_id IN ('view', 'purchase')""",
    "stream_late_rows": ORACLES["keyword_stats"].replace(PAGES, _LATE),
    "stream_product_words": _WORDS,
    "stream_product_word_changes": f"SELECT *, CAST(1 AS BIGINT) AS live FROM ({_WORDS})",
    "stream_province_topic": ORACLES["province_stats"],
    "stream_product_orders": f"""WITH {ITEMS} SELECT {stamp('day').split(' AS stt')[0]} AS stt, sku_id, CAST(sum(num) AS BIGINT) AS order_sku_num, CAST(sum(amount) AS {MONEY}) AS order_amount,
        count(DISTINCT order_id) AS order_ct, count(DISTINCT CASE WHEN status = 'F' THEN order_id END) AS paid_order_ct FROM items GROUP BY date_trunc('day', et), sku_id""",
    "result_days_merged": f"WITH {PAGES} SELECT CAST(strftime(et, '%Y%m%d') AS INTEGER) AS dt, page_id, count(*) AS ct FROM pages GROUP BY 1, 2",
    "upsert_pinned": f"""WITH {PAGES}, last AS (SELECT max(arrival) AS most FROM pages)
        SELECT mid, page_id, 'newest' AS at FROM pages QUALIFY row_number() OVER (PARTITION BY mid ORDER BY arrival DESC) = 1
        UNION ALL (SELECT mid, page_id, 'pinned' FROM pages, last WHERE arrival * 7 <= most QUALIFY row_number() OVER (PARTITION BY mid ORDER BY arrival DESC) = 1)""",
    "routes_as_of": """SELECT CASE WHEN year(o_orderdate) < 1996 THEN 'kafka' ELSE 'hbase' END AS sink_type, CASE WHEN year(o_orderdate) < 1994 THEN 'early' WHEN year(o_orderdate) < 1996 THEN 'late' ELSE 'dim_orders' END AS sink_table,
        CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN year(o_orderdate) < 1994 THEN o_orderstatus END AS status FROM orders WHERE year(o_orderdate) <> 1996""",
    "order_segments_as_of": """SELECT o_orderkey AS order_id, CASE WHEN o_orderdate < TIMESTAMP '1995-06-17' THEN c_mktsegment ELSE lower(c_mktsegment) END AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "segmented_names": f"""SELECT p_partkey, 'no ' || p_partkey || ' ' || CASE WHEN w[1] = w[2] THEN w[1] ELSE array_to_string(w, ' ') END AS words
        FROM (SELECT p_partkey, string_split(translate(lower(p_name), '{LETTERS}', '{GLYPHS}'), ' ') AS w FROM part)""",
    "product_look_ups": f"""WITH {ITEMS}, sold AS (SELECT sku_id, count(DISTINCT order_id) AS order_ct, CAST(sum(amount) AS {MONEY}) AS order_amount FROM items WHERE CAST(et AS DATE) = DATE '1996-01-15' GROUP BY 1)
        SELECT sku_id, order_ct, order_amount, p_name AS sku_name, CAST(p_retailprice AS {MONEY}) AS sku_price, CASE WHEN p_partkey % 5 > 0 THEN upper(p_name) END AS spu_name, p_brand AS tm_name, 'size ' || p_size AS category3_name
        FROM sold LEFT JOIN part ON sku_id = p_partkey""",
    "dashboard_answers": " UNION ALL ".join([
        _answer("gmv", "gmv", "'all'", "gmv"), _answer("tm", "gmv_by_brand", "name || ' order_amount'", "order_amount"), _answer("spu", "gmv_by_spu", "name", "order_amount"),
        *(_answer("c3", "gmv_by_category", f"name || ' {c}'", c) for c in ("order_amount", "order_ct")), _answer("province", "province_totals", "province_name", "order_amount"),
        *(_answer("visitor", "visitor_by_hour", f"hour || ' {c}'", f"{c}_ct") for c in ("uv", "pv")), _answer("visitor_is_new", "visitor_by_is_new", "is_new || ' uv_ct'", "uv_ct"), _answer("kw", "keyword_score", "keyword", "score"),
    ]),
}
