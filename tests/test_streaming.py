"""Streams against batches: what closes before the end of the stream is the same."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import logs, stats, visits
from millrace.sources import topics
from millrace.streaming import jobs, processors

FAR = 10**10


def page_files(root, seed):
    """Pages of three visitors in three files; the last file holds a far later page, which closes all before it."""
    rng = random.Random(seed)
    rows = [{"mid": rng.choice("abc"), "ts": rng.randint(0, 60_000), "arrival": k, "last_page_id": rng.choice(["", "x"])} for k in range(60)]
    rows.sort(key=lambda r: r["ts"])
    (root / "pages").mkdir()
    for k in range(3):
        part = rows[20 * k : 20 * k + 20] + ([{"mid": "z", "ts": FAR, "arrival": 999, "last_page_id": "x"}] if k == 2 else [])
        (root / "pages" / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(root / "pages" / f"{k}.json", (1_000_000 + 10 * k, 1_000_000 + 10 * k))  # files are read in order of time
    return rows


def stream_of(spark, root):
    raw = topics.read_topic(spark, str(root), "pages", streaming=True, max_files=1)
    p = raw.select(F.from_json("value", "mid string, ts long, arrival long, last_page_id string").alias("r"), "value").select("r.*", F.col("value").alias("body"))
    return p.withColumn("entry", visits.is_entry(F.col("last_page_id")))


@pytest.mark.parametrize("kind", ["new", "unique", "bounce"])
def test_processors_match_batches(spark, tmp_path, kind):
    processors.configure(spark)
    rows = page_files(tmp_path, 4)
    one = {"new": processors.NewVisitorProcessor, "unique": processors.UniqueVisitorProcessor, "bounce": processors.BounceProcessor}[kind]()
    out = processors.process(stream_of(spark, tmp_path), one, "2 seconds")
    q = out.writeStream.format("memory").queryName(f"got_{kind}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted((r.arrival, r.flag) for r in spark.table(f"got_{kind}").collect() if r.ts < FAR)
    df = spark.createDataFrame([(r["mid"], r["ts"], r["arrival"], r["last_page_id"], "p") for r in rows], "mid string, ts long, arrival long, last_page_id string, page_id string")
    want = {"new": lambda: logs.repair_is_new(df).select("arrival", "is_new"), "unique": lambda: visits.unique_visitors(df).select("arrival", F.lit("1")), "bounce": lambda: visits.bounces(df).select("arrival", F.lit("1"))}[kind]()
    assert got == sorted(tuple(r) for r in want.collect()) and got


def test_jobs(spark, tmp_path):
    root = str(tmp_path)
    lines = [{"common": {"mid": "m"}, "ts": 1000 * k, "page": {"page_id": "good_list", "item": "red ring"}, "displays": [{"item": "1"}]} for k in range(5)] + [{"common": {}, "start": {"a": "b"}, "ts": 1}, {"common": {"mid": "m"}, "ts": FAR, "page": {"page_id": "good_list", "item": "late"}}]
    topics.ingest_log(spark, root, map(json.dumps, lines))
    jobs.split_logs(spark, root, available_now=True).awaitTermination(240)
    assert [topics.read_topic(spark, root, t).count() for t in ("dwd_start_log", "dwd_page_log", "dwd_display_log")] == [1, 6, 5]
    jobs.keep_keyword_stats(spark, root, available_now=True).awaitTermination(240)
    got = spark.read.parquet(f"{root}/keyword_stats_2021").select("stt", "keyword", "ct").collect()
    assert sorted(map(tuple, got)) == [("1970-01-01 00:00:00", "red", 5), ("1970-01-01 00:00:00", "ring", 5)]
    spark.createDataFrame([("t", "insert", "kafka", "facts", "id,v", None, None), ("u", "insert", "hbase", "dim_u", "id,v", "id", None)], "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string, sink_extend string").write.parquet(f"{root}/routes")
    changes = [{"database": "d", "table": t, "type": "insert", "data": {"id": "1", "v": v, "secret": "s"}} for t, v in (("t", "a"), ("u", "b"), ("u", "c"))]
    topics.ingest_log(spark, root, map(json.dumps, changes), "ods_db")
    jobs.route_changes(spark, root, f"{root}/routes", available_now=True).awaitTermination(240)
    from millrace.sources.sinks import UpsertTable, read_routed

    assert [json.loads(r.value) for r in read_routed(spark, root, "facts").collect()] == [{"id": "1", "v": "a"}]
    assert [(r.id, r.v) for r in UpsertTable(spark, f"{root}/dims/dim_u", ["id"]).read().collect()] == [("1", "c")]


def test_joined_stream_into_windows(spark, tmp_path):
    root = str(tmp_path)
    o = [{"id": k, "province_id": 1, "user_id": 1, "create_time": f"2021-05-28 10:00:0{k}"} for k in range(3)] + [{"id": 9, "province_id": 1, "create_time": "2021-05-28 12:00:00"}]
    d = [{"id": 10 * r["id"] + j, "order_id": r["id"], "sku_id": 1, "split_total_amount": "2.50", "create_time": r["create_time"]} for r in o for j in (0, 1)]
    topics.ingest_log(spark, root, map(json.dumps, o), "dwd_order_info")
    topics.ingest_log(spark, root, map(json.dumps, d), "dwd_order_detail")
    provinces = spark.createDataFrame([(1, "north", "a", "i", "j")], "province_id long, province_name string, area_code string, iso_code string, iso_3166_2 string")
    jobs.keep_province_stats(spark, root, provinces, available_now=True).awaitTermination(240)
    got = spark.read.parquet(f"{root}/province_stats_2021").collect()
    assert [(r.stt, r.province_name, float(r.order_amount), r.order_count) for r in got] == [("2021-05-28 10:00:00", "north", 15.0, 3)]
    assert stats.VISITOR_DIMS


def test_split_logs_repairs_new_visitors(spark, tmp_path):
    root = str(tmp_path)
    page = lambda mid, ts, said: {"common": {"mid": mid, "is_new": said}, "ts": ts, "page": {"page_id": "home"}, "displays": [{"item": "1"}]}
    got = lambda topic: sorted((r.ts, r.mid, r.is_new) for r in topics.read_topic(spark, root, topic).select(F.from_json("value", "ts string, common map<string,string>, mid string, is_new string").alias("r")).select(F.col("r.ts").cast("long").alias("ts"), F.coalesce("r.mid", F.col("r.common")["mid"]).alias("mid"), F.coalesce("r.is_new", F.col("r.common")["is_new"]).alias("is_new")).collect())
    # b's first row comes in the second batch, before its window has closed; c's stays open to the end.
    topics.ingest_log(spark, root, map(json.dumps, [page("a", 1000, "0"), page("a", 2000, "1"), page("b", 8000, "1"), {"common": {"mid": "a", "is_new": "1"}, "ts": 3000, "start": {"x": "y"}}, page("a", 11_000, "1")]))
    jobs.split_logs(spark, root, available_now=True).awaitTermination(240)
    assert got("dwd_page_log") == [(1000, "a", "1"), (2000, "a", "0"), (11_000, "a", "0")] and got("dwd_start_log") == [(3000, "a", "0")]
    topics.ingest_log(spark, root, map(json.dumps, [page("b", 7000, "0"), page("c", 30_000, "0"), page("a", 29_000, "1")]))
    jobs.split_logs(spark, root, available_now=True).awaitTermination(240)
    want = [(1000, "a", "1"), (2000, "a", "0"), (7000, "b", "1"), (8000, "b", "0"), (11_000, "a", "0"), (29_000, "a", "0")]
    assert got("dwd_page_log") == want and got("dwd_display_log") == want


LOG_END = {"common": {"mid": "zz"}, "ts": FAR, "page": {"page_id": "home", "last_page_id": "x"}}


def page_log(mid, ts, page, last, **more):
    return {"common": {"mid": mid, "vc": "v", "ch": "c", "ar": "a", "is_new": "1"}, "ts": ts, "page": {"page_id": page, **({"last_page_id": last} if last else {}), **more}}


#: Two golden cases: rows, and what bounces in v1 and v2.
BOUNCES = [
    ([("101", 10000, "home", None), ("101", 20000, "other", None), ("102", 10000, "home", None), ("102", 39999, "good_list", "home"), ("102", 50000, "good_list", "detail")], {("101", 20000), ("102", 10000)}, {("101", 10000), ("101", 20000), ("102", 10000)}),
    ([("101", 10000, "home", None), ("101", 10000, "good_list", "home"), ("102", 10000, "home", None), ("102", 39999, "good_list", "home"), ("102", 50000, "good_list", "detail")], {("102", 10000)}, {("102", 10000)}),
]


def topic_rows(spark, root, name, schema):
    return topics.read_topic(spark, root, name).select(F.from_json("value", schema).alias("r")).select("r.*").collect()


@pytest.mark.parametrize("case", [0, 1])
@pytest.mark.parametrize("variant", ["v1", "v2"])
def test_golden_bounces_through_the_job(spark, tmp_path, case, variant):
    processors.configure(spark)
    root, (rows, v1, v2) = str(tmp_path), BOUNCES[case]
    topics.ingest_log(spark, root, [json.dumps(page_log(*r)) for r in rows] + [json.dumps(LOG_END)], "dwd_page_log")
    jobs.keep_bounces(spark, root, variant, available_now=True).awaitTermination(240)
    got = {(r.common["mid"], r.ts) for r in topic_rows(spark, root, "dwm_jump_detail", "common map<string,string>, ts long") if r.ts < FAR}
    assert got == {"v1": v1, "v2": v2}[variant]


def test_warehouse_from_end_to_end(spark, tmp_path):
    """Facts and pages through wide facts to the result tables."""
    processors.configure(spark)
    root, t = str(tmp_path), "2021-05-28 10:00:0"
    from millrace.sources.sinks import UpsertTable

    dims = {"dim_sku_info": [("1", "ring", "11", "21", "31", "9.50")], "dim_spu_info": [("11", "gold ring")], "dim_base_trademark": [("21", "brand")], "dim_base_category3": [("31", "jewels")], "dim_user_info": [("5", "2000-05-28", "F")], "dim_base_province": [("7", "north", "a", "i", "j")]}
    for name, columns in jobs.DIMENSIONS.values():
        rows = spark.createDataFrame([(*r, 1) for r in dims[name]], [*columns.split(), "seq"])
        UpsertTable(spark, f"{root}/dims/{name}", ["id"], as_text=True).upsert(rows, "seq")
    put = lambda topic, *rows: topics.ingest_log(spark, root, map(json.dumps, rows), topic)
    late = "2021-05-28 12:00:00"
    put("dwd_order_info", {"id": 1, "province_id": 7, "user_id": 5, "total_amount": "5.00", "create_time": t + "1"}, {"id": 9, "create_time": late})
    put("dwd_order_detail", *({"id": k, "order_id": 1, "sku_id": 1, "sku_num": 2, "split_total_amount": "2.50", "create_time": t + "2"} for k in (1, 2)), {"id": 9, "order_id": 8, "create_time": late})
    jobs.keep_order_wide(spark, root, "2021-05-28", available_now=True).awaitTermination(240)
    wide = topic_rows(spark, root, "dwm_order_wide", "order_id long, user_age int, user_gender string, province_name string, tm_name string, spu_name string, category3_name string")
    assert [tuple(r) for r in wide] == [(1, 21, "F", "north", "brand", "gold ring", "jewels")] * 2
    put("dwm_order_wide/batch=99", {"order_id": 99, "create_time": late})
    put("dwd_payment_info", {"id": 3, "order_id": 1, "user_id": 5, "total_amount": "5.00", "create_time": t + "3"}, {"id": 4, "order_id": 98, "create_time": late})
    jobs.keep_payment_wide(spark, root, available_now=True).awaitTermination(240)
    assert [(r.payment_id, r.order_id) for r in topic_rows(spark, root, "dwm_payment_wide", "payment_id long, order_id long")] == [(3, 1)] * 2
    second = 1622196000000
    put("dwd_page_log", page_log("m", second + 1000, "good_detail", None, item="1", during_time="7"), page_log("m", second + 2000, "home", "good_detail", during_time="1"), page_log("zz", second + 7_200_000, "good_detail", "x", item="1"))
    put("dwm_uv", page_log("m", second + 1000, "good_detail", None), LOG_END | {"ts": second + 7_200_000})
    put("dwm_jump_detail", page_log("m", second + 1500, "home", None), LOG_END | {"ts": second + 7_200_000})
    jobs.keep_visitor_stats(spark, root, available_now=True).awaitTermination(240)
    got = spark.read.parquet(f"{root}/visitor_stats_2021").filter("stt < '2021-05-28 11'").collect()
    assert [(r.stt, r.uv_ct, r.pv_ct, r.sv_ct, r.uj_ct, r.dur_sum) for r in got] == [("2021-05-28 10:00:00", 1, 2, 1, 1, 8)]
    put("dwd_display_log", {"item": "1", "item_type": "sku_id", "ts": second + 1000}, {"item": "1", "item_type": "sku_id", "ts": second + 7_200_000})
    put("dwm_payment_wide/batch=99", {"sku_id": 1, "payment_create_time": late})
    for name, more in {"dwd_favor_info": {}, "dwd_cart_info": {}, "dwd_order_refund_info": {"order_id": 1, "refund_amount": "1.00"}, "dwd_comment_info": {"appraise": "1204"}}.items():
        put(name, {"sku_id": 1, "create_time": t + "4", **more}, {"sku_id": 1, "create_time": late, **more})
    jobs.keep_product_stats(spark, root, available_now=True).awaitTermination(240)
    r = spark.read.parquet(f"{root}/product_stats_2021").filter("stt < '2021-05-28 11'").collect()
    assert len(r) == 1 and float(r[0].sku_price) == 9.5 and (r[0].spu_name, r[0].tm_name, r[0].category3_name) == ("gold ring", "brand", "jewels")
    names = "display_ct click_ct favor_ct cart_ct order_sku_num order_ct paid_order_ct refund_order_ct comment_ct good_comment_ct".split()
    assert [r[0][c] for c in names] == [1, 1, 1, 1, 4, 1, 1, 1, 1, 1] and float(r[0].order_amount) == 5.0 == float(r[0].payment_amount)
    jobs.keep_keyword_products(spark, root, available_now=True).awaitTermination(240)
    words = spark.read.parquet(f"{root}/keyword_stats_2021_products").filter("stt < '2021-05-28 11'").collect()
    assert sorted((w.keyword, w.source, w.ct) for w in words) == sorted((k, s, 1) for k in ("gold", "ring") for s in ("cart", "click", "order"))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    from millrace.sources import sinks

    root = str(tmp_path)
    rows = spark.createDataFrame([("t", {"id": "1"})], "sink_table string, data map<string,string>")
    table = spark.createDataFrame([("2021-05-28 00:00:00", 1)], "stt string, x int")
    for batch in (0, 0, 1, 1):
        sinks.write_routed(rows, root, batch)
        sinks.write_table(table, root, "t", batch=batch)
        sinks.write_topic(table, root, "out", batch)
    assert sinks.read_routed(spark, root, "t").count() == 2 and spark.read.parquet(f"{root}/t").count() == 2 and topics.read_topic(spark, root, "out").count() == 2


def test_upserts_survive_writers_that_stop_between_steps(spark, tmp_path):
    import shutil

    from millrace.sources.sinks import UpsertTable

    path = f"{tmp_path}/dim"
    row = lambda *ids: spark.createDataFrame([(i, v, 1) for i, v in ids], "id int, v int, seq int")
    held = lambda: sorted((r.id, r.v) for r in UpsertTable(spark, path, ["id"]).read().collect())
    table = UpsertTable(spark, path, ["id"], buckets=4)
    table.upsert(row(*((k, 0) for k in range(20))), "seq")
    table.upsert(row((1, 5)), "seq")
    want = sorted([(k, 0) for k in range(20) if k != 1] + [(1, 5)])
    assert held() == want
    # Stopped behind the buckets, and again within the list.
    table.upsert(row((2, 7)), "seq")
    shutil.rmtree(f"{path}/_versions/00000003")
    assert held() == want
    os.makedirs(f"{path}/_versions/00000003")
    assert held() == want
    for v in range(4):
        table.upsert(row((3, v)), "seq")
    assert held() == sorted([(k, 0) for k in range(20) if k not in (1, 3)] + [(1, 5), (3, 3)])
    assert len(table._lists()) <= 3
    assert not list(UpsertTable(spark, f"{tmp_path}/none", ["id"])._lists())
