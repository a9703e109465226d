"""Rows of windows that are open wait in files."""

from pyspark.sql import functions as F

from millrace.plans import feeds
from millrace.sources.sinks import OpenWindows

SMALL = "/root/testdata/sf0.001"


def test_windows_close_once_and_late_rows_drop(spark, tmp_path):
    held, out = OpenWindows(spark, str(tmp_path / "open"), "10 seconds", 5_000), {}
    rows = lambda *seconds: spark.createDataFrame([(k,) for k in seconds], "s long").withColumn("et", F.timestamp_seconds("s"))

    def take(number, *seconds):
        held.take(rows(*seconds), number, lambda closed: out.setdefault(number, sorted(r.s for r in closed.collect())))

    take(0, 1, 12, 14)
    take(1, 2, 16, 3)  # [0, 10) is open until 15 is met
    take(1, 2, 16, 3)  # runs again behind its end
    take(2, 4, 15, 24)  # 4 is late: its window closed with the batch before
    take(3, 40)
    assert out == {0: [], 1: [1, 2, 3], 2: [], 3: [12, 14, 15, 16, 24]}


def test_a_batch_that_was_killed_before_its_list_gives_the_same_windows(spark, tmp_path):
    held, out = OpenWindows(spark, str(tmp_path / "open"), "10 seconds", 0), []
    rows = spark.range(25).withColumn("et", F.timestamp_seconds("id"))
    commit = held._commit
    held._commit = lambda *_: None
    held.take(rows, 0, lambda closed: out.append(closed.count()))
    held._commit = commit
    held.take(rows, 0, lambda closed: out.append(closed.count()))
    held.take(rows.filter("false"), 1, lambda closed: out.append(closed.count()))
    assert out == [20, 20, 0]


def test_product_orders_hold_no_state_by_line(spark):
    before = {q.id for q in spark.streams.active}
    seen = []
    run = feeds.jobs.run_stream
    feeds.jobs.run_stream = lambda df, *a, **b: (seen.append(df._jdf.queryExecution().analyzed().toString()), run(df, *a, **b))[1]
    try:
        assert feeds.QUERIES["stream_product_orders"](spark, SMALL).count() > 0
    finally:
        feeds.jobs.run_stream = run
    assert seen and "Aggregate" not in seen[0] and {q.id for q in spark.streams.active} == before
