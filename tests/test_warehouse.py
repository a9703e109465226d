"""Golden cases and closed forms against event-by-event models."""

import datetime
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.config import DAY_MS
from millrace.functions.metrics import by_source
from millrace.functions.text import register_tokenizer, segment, tokens
from millrace.functions.time import age_on, from_ms, to_ms
from millrace.operators import binlog, logs, orders, stats, visits
from millrace.operators.dims import DimSpec, join_dims
from millrace.plans import serving
from millrace.sources import sinks, topics

PAGE = "mid string, ts long, page_id string, last_page_id string, arrival long"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], PAGE)


def found(df):
    return sorted((r.mid, r.ts) for r in df.collect())


def test_bounce_cases(spark):
    rows = [("101", 10000, "home", None), ("101", 20000, "other", ""), ("102", 10000, "home", None), ("102", 39999, "good_list", "home"), ("102", 50000, "good_list", "detail")]
    assert found(visits.bounces(pages_of(spark, rows), "v1")) == [("101", 20000), ("102", 10000)]
    assert found(visits.bounces(pages_of(spark, rows))) == [("101", 10000), ("101", 20000), ("102", 10000)]
    tie = [("101", 10000, "home", None), ("101", 10000, "good_list", "home"), *rows[2:]]
    assert found(visits.bounces(pages_of(spark, tie))) == [("102", 10000)]
    for gap, want in ((4999, []), (5000, [("m", 0)])):
        assert found(visits.bounces(pages_of(spark, [("m", 0, "home", None), ("m", gap, "x", "home")]))) == want
    assert found(visits.bounces(pages_of(spark, [("m", 0, "h", None), ("m", 1000, "h", None)]))) == [("m", 0), ("m", 1000)]


def random_pages(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice("abc"), rng.choice([rng.randint(0, 3 * DAY_MS), DAY_MS - rng.randint(1, 9000), rng.randint(0, 90000)]), "p", rng.choice([None, "", "x", "y"])) for _ in range(n)]


def in_order(rows):
    by = {}
    for k, r in enumerate(rows):
        by.setdefault(r[0], []).append((r[1], k, r[3]))
    return {m: sorted(v, key=lambda x: (x[0], x[1])) for m, v in by.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closed_forms_against_models(spark, seed):
    rows = random_pages(seed)
    df = pages_of(spark, rows).repartition(3)
    fresh, seen, ever, v1, v2 = set(), [], [], [], []
    for mid, own in in_order(rows).items():
        fresh.add((mid, own[0][1]))
        ever.append((mid, own[0][0]))
        state, windows = None, {}
        for ts, _, _ in own:
            windows.setdefault(ts // 5000 * 5000 + 5000, ts)
        for end, ts in sorted(windows.items()):
            if state is None or state // DAY_MS != end // DAY_MS:
                state = ts
                seen.append((mid, ts))
        for k, (ts, _, last) in enumerate(own):
            after = own[k + 1] if k + 1 < len(own) else None
            if not last and (after is None or after[0] - ts >= 20000):
                v1.append((mid, ts))
            if not last and (after is None or after[0] - ts >= 5000 or not after[2]):
                v2.append((mid, ts))
    assert {(r.mid, r.arrival) for r in logs.repair_is_new(df).filter("is_new = '1'").collect()} == fresh
    assert found(visits.unique_visitors(df)) == sorted(seen)
    assert found(visits.unique_visitors(df, "lifetime")) == sorted(ever)
    assert found(visits.bounces(df, "v1")) == sorted(v1) and found(visits.bounces(df)) == sorted(v2)


def test_new_and_unique_visitors(spark):
    rows = [("a", 3000, "p", None), ("a", 1000, "p", None), ("a", 7000, "p", None)]
    assert sorted((r.ts, r.is_new) for r in logs.repair_is_new(pages_of(spark, rows)).collect()) == [(1000, "1"), (3000, "0"), (7000, "0")]
    rows = [("a", t, "p", None) for t in (1000, 3000, 50000, DAY_MS - 3000, DAY_MS + 1000)]
    times = lambda mode: [t for _, t in found(visits.unique_visitors(pages_of(spark, rows), mode))]
    assert times("reference") == [1000, DAY_MS - 3000, DAY_MS + 1000]
    assert times("calendar_day") == [1000, DAY_MS + 1000] and times("lifetime") == [1000]


def test_log_split(spark):
    raw = [{"start": {"e": "1"}}, {"start": {"e": "1"}, "page": {"page_id": "p"}, "displays": [{"item": "1"}]}, {"page": {"page_id": "p"}}, {"page": {"page_id": "q"}, "displays": [{"item": "1", "ts": "d", "mid": "d"}, {"item": "2"}]}, {}, {"displays": [{"item": "3"}]}]
    lines = spark.createDataFrame([(json.dumps({"common": {"mid": "m"}, "ts": 5, **r}),) for r in raw], "value string")
    start, page, display = logs.split_log(logs.parse_log(lines))
    assert (start.count(), page.count()) == (2, 2)
    assert sorted(sorted((k, v) for k, v in r.display.items() if v is not None) for r in display.collect()) == sorted(
        [[("item", "1"), ("mid", "m"), ("page_id", "q"), ("ts", "5")], [("item", "2"), ("mid", "m"), ("page_id", "q"), ("ts", "5")], [("item", "3"), ("mid", "m"), ("ts", "5")]]
    )


def test_etl_and_routes(spark):
    data = {"id": "1234"}
    rows = [("d", "t", k, data) for k in ("insert", "update", "bootstrap-insert", "delete", "bootstrap-start")] + [("d", None, "insert", data), ("d", "t", "insert", None), ("d", "t", "insert", {"a": "1"}), ("d", "t", "insert", {"a": "1234"})]
    kept = binlog.etl_binlog(spark.createDataFrame(rows, "database string, `table` string, type string, data map<string,string>"))
    assert sorted((r.type, len(r.data)) for r in kept.collect()) == [("bootstrap-insert", 1), ("insert", 1), ("insert", 1), ("update", 1)]
    config = [("t", "insert", "KAFKA", "topic", "id, x,y", None, None, "+I", 1), ("t", "update", "clickhouse", "z", "id", None, None, "+I", 2), ("u", "insert", "hbase", "dim", "id", "id", None, "+I", 3), ("u", "insert", "hbase", "dim", "id", "id", None, "-D", 4)]
    changes = spark.createDataFrame(config, "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string, sink_extend string, op string, seq int")
    assert binlog.merged_routes(changes).count() == 2 and binlog.merged_routes(changes, sticky=True).count() == 3
    facts = spark.createDataFrame([("d", "t", "bootstrap-insert", {"id": "1", "x": "2", "y": "3"}), ("d", "t", "update", {"id": "1"}), ("d", "u", "insert", {"id": "1"})], "database string, `table` string, type string, data map<string,string>")
    assert [(r.sink_table, r.data) for r in binlog.route(facts, binlog.merged_routes(changes)).collect()] == [("topic", {"id": "1", "y": "3"})]


def at(seconds):
    return datetime.datetime(2021, 5, 28, 0, 0) + datetime.timedelta(seconds=seconds)


def test_interval_joins_and_dims(spark):
    o = orders.with_create_parts(spark.createDataFrame([(1, 7, 5, "2021-05-28 10:00:10"), (2, 8, 5, "2021-05-28 10:00:10")], "id long, province_id long, user_id long, create_time string"))
    for c in ("total_amount", "activity_reduce_amount", "coupon_reduce_amount", "original_total_amount", "feight_fee"):
        o = o.withColumn(c, F.lit(1).cast("decimal(20,2)"))
    o = o.withColumn("order_status", F.lit("s")).withColumn("et", F.lit(at(10)))
    d = spark.createDataFrame([(k, 1, k, at(t)) for k, t in enumerate((5, 15, 4.999, 15.001))], "id long, order_id long, sku_id long, et timestamp")
    for c in ("order_price", "split_total_amount", "split_activity_amount", "split_coupon_amount"):
        d = d.withColumn(c, F.lit(2).cast("decimal(20,2)"))
    d = d.withColumns({"sku_num": F.lit(1).cast("long"), "sku_name": F.lit("n")})
    wide = orders.order_wide(o, d)
    assert sorted(r.detail_id for r in wide.collect()) == [0, 1] and wide.first().create_hour == "10" and wide.first().expire_time is None
    specs = [DimSpec(spark.createDataFrame([("7", "north")], "id string, name string"), "province_id", {"province_name": "name"}), DimSpec(spark.createDataFrame([("9", "3")], "id string, tm_id string"), "sku_id", {"tm_id": F.col("tm_id").cast("bigint")}), DimSpec(spark.createDataFrame([("3", "b")], "id string, tm string"), "tm_id", {"tm_name": "tm"})]
    assert {(r.province_name, r.tm_name) for r in join_dims(wide, specs).collect()} == {("north", None)}
    pay = spark.createDataFrame([(1, 4, 99, Decimal("5.00"), at(3600))], "id long, order_id long, user_id long, total_amount decimal(20,2), et timestamp")
    pay = pay.withColumns({c: F.lit(None).cast("string") for c in ("subject", "payment_type", "callback_time", "create_time")})
    w = spark.createDataFrame([(4, 1, Decimal("9.00"), k, at(60 * m + s)) for k, (m, s) in enumerate(((15, 0), (61, 0), (14, 59), (61, 1)))], "order_id long, user_id long, total_amount decimal(20,2), k int, et timestamp").withColumn("create_time", F.lit("c"))
    assert sorted((r.k, r.user_id, r.total_amount) for r in orders.payment_wide(pay, w).collect()) == [(0, 99, Decimal("5.00")), (1, 99, Decimal("5.00"))]
    assert spark.range(1).select(age_on(F.to_date(F.lit("2000-05-28")), F.to_date(F.lit("2021-05-28")))).first()[0] == 21


def test_visitor_and_product_windows(spark):
    schema = "et timestamp, vc string, ch string, ar string, is_new string, during_time long, last_page_id string"
    p = spark.createDataFrame([(at(0), "v", "c", "a", "1", 10, None), (at(4.999), "v", "c", "a", "1", 5, "x"), (at(5), "v", "c", "a", "1", None, "x")], schema)
    out = sorted(stats.visitor_stats(p, p.limit(0), p.limit(0)).collect())
    assert [(r.pv_ct, r.sv_ct, r.dur_sum, r.uv_ct) for r in out] == [(2, 1, 15, 0), (1, 0, 0, 0)] and out[0].edt == "2021-05-28 00:00:05"
    refund = spark.createDataFrame([(at(1), 1, 7, Decimal("10.00"), 1), (at(0), 1, 7, Decimal("5.00"), 2), (at(2), 1, 8, Decimal("1.00"), 3)], "et timestamp, sku_id long, order_id long, refund_amount decimal(20,2), arrival long")
    order = spark.createDataFrame([(at(1), 1, n, 2, Decimal("3.00"), 9) for n in (100, 100, 101)], "et timestamp, sku_id long, order_id long, sku_num long, split_total_amount decimal(20,2), arrival long")
    comment = spark.createDataFrame([(at(1), 1, a, 9) for a in ("1204", "1205", "1201")], "et timestamp, sku_id long, appraise string, arrival long")
    sources = {"refund": refund, "order": order, "comment": comment}
    r = stats.product_stats(sources).first()
    assert (r.refund_order_ct, r.refund_amount, r.order_ct, r.order_amount, r.comment_ct, r.good_comment_ct) == (2, Decimal("16.00"), 2, Decimal("9.00"), 3, 2)
    assert stats.product_stats({"refund": refund}, refund_mode="double_add").first().refund_amount == Decimal("22.00")
    facts = spark.createDataFrame([(1, Decimal("10.00")), (1, Decimal("2.50")), (2, Decimal("1.00"))], "order_id long, split_total_amount decimal(20,2)")
    facts = facts.withColumns({"et": F.lit(at(0)), "province_id": F.lit(1), **{c: F.lit("n") for c in ("province_name", "area_code", "iso_code", "iso_3166_2")}})
    r = stats.province_stats(facts).first()
    assert (r.order_amount, r.order_count) == (Decimal("13.50"), 2)


def test_functions(spark):
    row = spark.createDataFrame([(3, 0, 2), (0, 0, 0)], "c long, o long, k long").select(by_source({"click": F.col("c"), "order": F.col("o"), "cart": F.col("k")}).alias("x")).collect()
    assert [[tuple(y) for y in r.x] for r in row] == [[("click", 3), ("cart", 2)], []]
    texts = ["red red Apple", "", "手机 x-1", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [sorted(r[0]) if r[0] is not None else [] for r in df.select(tokens(F.col("t"))).collect()] == [sorted(segment(t)) for t in texts]
    register_tokenizer(spark)
    df.createOrReplaceTempView("texts")
    assert sorted(r.w for r in spark.sql("SELECT w FROM texts, LATERAL tokenize(t)").collect()) == sorted(w for t in texts for w in segment(t))
    one = spark.createDataFrame([("2021-05-28 10:00:00",), ("bad",), (None,)], "t string").select(to_ms(F.col("t")).alias("m"), from_ms(to_ms(F.col("t"))).alias("b")).collect()
    assert [(r.m, r.b) for r in one] == [(1622196000000, "2021-05-28 10:00:00"), (0, "1970-01-01 00:00:00"), (None, None)]


def test_serving(spark):
    rows = [("2021-05-28 03:00:00", b, Decimal(a), 1) for b, a in (("A", "5"), ("B", "7"), ("C", "5"))] + [("2021-05-27 03:00:00", "A", Decimal("99"), 1)]
    p = spark.createDataFrame(rows, "stt string, tm_name string, order_amount decimal(20,2), order_ct long")
    assert [r.name for r in serving.gmv_by_brand(p, 20210528, 2).collect()] == ["B", "A"]
    assert serving.gmv(p, 20210528).first().gmv == Decimal("17.00") and serving.gmv(p, 20210101).first().gmv is None
    k = spark.createDataFrame([("2021-05-28 00:00:00", "k", s, 1) for s in ("search", "click", "order", "cart")], "stt string, keyword string, source string, ct long")
    assert serving.keyword_score(k, 20210528).first().score == 17 and serving.keyword_score(k, 20210528, search_weight=10).first().score == 25
    v = spark.createDataFrame([("2021-05-28 03:00:00", "1", 1, 2, 3, 4)], "stt string, is_new string, uv_ct long, pv_ct long, sv_ct long, uj_ct long")
    body = json.loads(serving.serve("visitor", {"visitor": v}, 20210528))
    assert body["data"]["categories"] == [f"{h:02d}" for h in range(24)] and body["data"]["series"][1]["data"] == [0, 0, 0, 2] + [0] * 20
    assert json.loads(serving.serve("tm", {"product": p}, 20210528, 1)) == {"status": 0, "msg": "", "data": {"categories": ["B"], "series": [{"name": "order_amount", "data": [7.0]}]}}


def test_sinks(spark, tmp_path):
    root = str(tmp_path)
    topics.ingest_log(spark, root, ['{"a":1}', "{}"])
    assert topics.read_topic(spark, root, "ods_log").count() == 2
    dim = sinks.UpsertTable(spark, f"{root}/dim", ["id"], as_text=True)
    dim.upsert(spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, None, 3)], "id int, v int, seq int"), "seq")
    dim.upsert(spark.createDataFrame([(2, 9, 1), (3, 1, 1)], "id int, v int, seq int"), "seq")
    assert sorted((r.id, r.v) for r in dim.read().collect()) == [("1", "6"), ("2", "9"), ("3", "1")]
    wide = spark.createDataFrame([("2021-05-28 00:00:00", 1, [1])], "stt string, x int, order_ids array<int>")
    sinks.write_table(wide, root, "t")
    assert spark.read.parquet(f"{root}/t").columns == ["stt", "x", "dt"]
    sinks.write_topic(spark.createDataFrame([(1, None)], "a int, b string"), root, "out")
    assert topics.read_topic(spark, root, "out").first().value == '{"a":1}'
