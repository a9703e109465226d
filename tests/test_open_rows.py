"""Rows of a stream that wait for what follows them, and how often a line of a topic is parsed."""

import json

from pyspark.sql import functions as F

from millrace.plans import streams
from millrace.plans.samples import Samples
from millrace.sources import topics
from millrace.sources.sinks import OpenRows
from millrace.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def test_rows_are_due_once_and_late_ones_drop(spark, tmp_path):
    held, out = OpenRows(spark, str(tmp_path / "open"), 5_000, 2_000), {}
    rows = lambda *times: spark.createDataFrame([(t, str(t)) for t in times], "ts long, body string").coalesce(1)

    def take(number, *times):
        held.take(rows(*times), number, lambda pending, due: out.setdefault(number, [(r.ts, r.due) for r in pending.withColumn("due", due).orderBy("ts", "arrival").collect()]))

    take(0, 3_000, 1_000, 8_000)
    take(1, 6_000, 6_001, 10_000)  # what is no later than 6000 is behind the watermark
    take(1, 6_000, 6_001, 10_000)  # runs again behind its end
    take(2, 99_000)
    assert out == {0: [(1_000, True), (3_000, False), (8_000, False)], 1: [(3_000, True), (6_001, False), (8_000, False), (10_000, False)], 2: [(6_001, True), (8_000, True), (10_000, True), (99_000, False)]}


def test_a_batch_that_was_killed_before_its_list_decides_the_same(spark, tmp_path):
    held, out = OpenRows(spark, str(tmp_path / "open"), 5, 0), []
    rows, commit = spark.range(25).select(F.col("id").alias("ts")), held._commit
    decide = lambda pending, due: out.append(pending.filter(due).count())
    held._commit = lambda *_: None
    held.take(rows, 0, decide)
    held._commit = commit
    held.take(rows, 0, decide)
    held.take(rows.filter("false"), 1, decide)
    assert out == [20, 20, 0]


def test_rows_of_one_time_follow_each_other_as_they_came_over_batches(spark, tmp_path):
    root = str(tmp_path)
    page = lambda ts, last, k: json.dumps({"common": {"mid": "a"}, "ts": ts, "page": {"page_id": k, **({"last_page_id": last} if last else {})}})
    for lines in ([page(1000, None, "first")], [page(1000, "first", "second")], [page(90_000, None, "third")], [page(10**9, "x", "end")]):
        topics.ingest_log(spark, root, lines, "dwd_page_log")
        jobs.keep_bounces(spark, root, "v1", available_now=True).awaitTermination(240)
    got = topics.read_topic(spark, root, "dwm_jump_detail").select(F.get_json_object("value", "$.page.page_id")).collect()
    assert [r[0] for r in got] == ["third"]


def test_bounces_are_decided_without_python_or_stores(spark):
    t = streams.Topics(Samples(spark, SMALL))
    t.pages()
    plans, run = [], jobs.run_stream
    jobs.run_stream = lambda df, *a, **b: (plans.append(df._jdf.queryExecution().analyzed().toString()), run(df, *a, **b))[1]
    try:
        t.run(jobs.keep_bounces)
    finally:
        jobs.run_stream = run
    assert plans and "Python" not in plans[0] and "State" not in plans[0] and t.rows("dwm_jump_detail").count() > 0


def test_a_line_is_parsed_once(spark):
    lines = spark.createDataFrame([('{"common": {"mid": "a"}, "ts": 1}',), ('{"common": {"mid": "b"}}',), ("no json",)], "value string").repartition(1)
    pages = jobs.visited(lines)
    assert pages._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [tuple(r) for r in pages.collect()] == [("a", 1, None, '{"common": {"mid": "a"}, "ts": 1}')]
