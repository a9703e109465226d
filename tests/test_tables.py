"""Versioned tables: replays, kills between steps, pins, running sums, changes, merged days; committed topics; JDBC ranges."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import files, sinks, topics
from millrace.sources.sinks import ResultTable, UpsertTable, buckets_of


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id int, v int, seq int")


def held(table, version=None):
    return sorted((r.id, r.v) for r in table.read(version).collect())


def test_pinned_versions_stay_through_fifty_upserts(spark, tmp_path):
    table = UpsertTable(spark, f"{tmp_path}/dim", ["id"], buckets=2)
    table.upsert(rows(spark, *((k, 0, 1) for k in range(10))), "seq")
    frame, pinned = table.read(), table.pin("report")
    for k in range(1, 51):
        table.upsert(rows(spark, (k % 10, k, 1)), "seq")
    assert sorted((r.id, r.v) for r in frame.collect()) == held(table, pinned) == [(k, 0) for k in range(10)]
    assert len(table._lists()) <= 4
    table.release("report")
    table.upsert(rows(spark, (0, 99, 1)), "seq")
    assert pinned not in table._lists()
    assert len(files.names(spark, f"{tmp_path}/dim")) < 10


def test_retention_by_age(spark, tmp_path):
    table = UpsertTable(spark, f"{tmp_path}/dim", ["id"], buckets=1, keep_seconds=3600)
    frames = []
    for k in range(6):
        table.upsert(rows(spark, (1, k, 1)), "seq")
        frames.append(table.read())
    assert [f.first().v for f in frames] == list(range(6))


def test_sums_and_changes_by_batch(spark, tmp_path):
    table = UpsertTable(spark, f"{tmp_path}/sums", ["k"], buckets=4)
    add = lambda batch, *values: table.add(spark.createDataFrame(list(values), "k string, ct long"), ["ct"], batch)
    changes = lambda batch: sorted((r.k or "", r.ct, r.op) for r in table.changes_of(batch).collect())
    add(0, ("a", 1), ("a", 2), (None, 5))
    assert changes(0) == [("", 5, "+I"), ("a", 3, "+I")]
    for _ in range(2):
        add(1, ("a", 10), ("b", 1))
        assert changes(1) == [("a", 3, "-U"), ("a", 13, "+U"), ("b", 1, "+I")]
    add(2)
    assert changes(2) == [] and table.last_batch() == 2
    add(3, ("c", 0))
    assert sorted((r.k or "", r.ct) for r in table.read().collect()) == [("", 5), ("a", 13), ("b", 1), ("c", 0)]
    add(2, ("a", 100))
    assert sorted((r.k or "", r.ct) for r in table.read().collect()) == [("", 5), ("a", 13), ("b", 1), ("c", 0)]


def test_an_upsert_killed_before_its_list(spark, tmp_path, monkeypatch):
    table = UpsertTable(spark, f"{tmp_path}/dim", ["id"], buckets=2)
    table.upsert(rows(spark, (1, 1, 1), (2, 2, 1)), "seq", 0)

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(files, "rename", killed)
        with pytest.raises(RuntimeError):
            table.upsert(rows(spark, (1, 7, 1)), "seq", 1)
    assert held(table) == [(1, 1), (2, 2)]
    table.upsert(rows(spark, (1, 7, 1)), "seq", 1)
    table.upsert(rows(spark, (1, 9, 1)), "seq", 1)
    assert held(table) == [(1, 7), (2, 2)]


def result(spark, *values):
    return spark.createDataFrame(list(values), "stt string, x int")


def test_result_days_are_merged_and_counted_once(spark, tmp_path):
    table = ResultTable(spark, f"{tmp_path}/t", most=3, keep_seconds=0)
    want = []
    for batch in range(12):
        day = f"2021-05-{28 + batch % 2}"
        new = [(f"{day} 00:00:0{batch % 10}", batch), ("2021-06-01 00:00:00", batch)]
        for _ in range(2):
            table.append(result(spark, *new), batch)
        want += new
    got = table.read()
    assert sorted((r.stt, r.x) for r in got.collect()) == sorted(want)
    by_day = {}
    for f in table.folders():
        by_day.setdefault(f.partition("/")[2], []).append(f)
    assert len(by_day) == 3 and all(len(x) <= 4 for x in by_day.values())
    assert "PartitionFilters: [isnotnull(dt" in got.filter("dt = 20210601")._jdf.queryExecution().toString()
    # No more is left than the last lists name.
    left = [b for b in files.names(spark, f"{tmp_path}/t") if "dt=20210601" in files.names(spark, f"{tmp_path}/t/{b}")]
    assert len(left) <= 8
    assert sorted((r.stt, r.x) for r in sinks.read_table(spark, str(tmp_path), "t").collect()) == sorted(want)


def test_result_batches_killed_between_steps(spark, tmp_path, monkeypatch):
    table = ResultTable(spark, f"{tmp_path}/t")
    table.append(result(spark, ("2021-05-28 00:00:00", 1)), 0)
    for at in range(2):  # stopped at each rename: of the batch, and of the list
        real, seen = files.rename, []

        def rename(spark, source, target, real=real, seen=seen, at=at):
            seen.append(target)
            if len(seen) > at:
                raise RuntimeError("killed")
            real(spark, source, target)

        with monkeypatch.context() as m:
            m.setattr(files, "rename", rename)
            with pytest.raises(RuntimeError):
                table.append(result(spark, ("2021-05-28 00:00:00", 2), ("2021-05-29 00:00:00", 3)), 1)
        assert [r.x for r in table.read().collect()] == [1]
    table.append(result(spark, ("2021-05-28 00:00:00", 2), ("2021-05-29 00:00:00", 3)), 1)
    assert sorted(r.x for r in table.read().collect()) == [1, 2, 3]


def test_topics_of_one_batch_are_committed_each_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    both = spark.createDataFrame([("a", {"id": "1"}), ("b", {"id": "2"})], "sink_table string, data map<string,string>")
    real = files.rename

    def once(spark, source, target, seen=[]):  # noqa: B006
        if seen:
            raise RuntimeError("killed")
        seen.append(target)
        real(spark, source, target)

    with monkeypatch.context() as m:
        m.setattr(files, "rename", once)
        with pytest.raises(RuntimeError):
            sinks.write_routed(both, root, 0)
    first = files.names(spark, f"{root}/routed/sink_table=a/batch=0")
    sinks.write_routed(both, root, 0)
    assert sinks.read_routed(spark, root, "a").count() == sinks.read_routed(spark, root, "b").count() == 1
    assert files.names(spark, f"{root}/routed/sink_table=a/batch=0") == first  # what readers may have seen stays


def test_clauses_of_created_tables():
    assert [buckets_of(x) for x in (None, "", "SALT_BUCKETS = 3", "salt_buckets=40, TTL=9", "TTL=9")] == [16, 16, 3, 40, 16]


def test_jdbc_by_ranges_and_keys(spark):
    url, rng = "jdbc:derby:memory:ranges;create=true", random.Random(1)
    keys = [rng.choice([rng.randint(0, 9), rng.randint(-5, 10**9)]) for _ in range(2000)] + [7] * 500 + [None] * 20
    frame = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "K long, V int")
    frame.write.jdbc(url, "t", mode="overwrite")
    got = topics.read_jdbc(spark, url, "t", "K", 6)
    sizes = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert sorted(r.V for r in got.collect()) == list(range(len(keys)))
    assert 4 <= got.rdd.getNumPartitions() <= 8 and max(r["count"] for r in sizes) < 900
    wanted = spark.createDataFrame([(7,), (3,), (None,), (-99,)], "x long")
    for most in (10_000, 1):
        found = topics.lookup_jdbc(spark, url, "t", "K", wanted, most=most)
        assert sorted(r.V for r in found.collect()) == [i for i, k in enumerate(keys) if k in (7, 3)]
    assert topics.lookup_jdbc(spark, url, "t", "K", wanted.filter("x IS NULL")).count() == 0
    assert topics.read_jdbc(spark, url, "SELECT COUNT(*) AS n FROM t").first()[0] == len(keys)
    spark.createDataFrame([], "K long, V int").write.jdbc(url, "empty_one", mode="overwrite")
    assert topics.read_jdbc(spark, url, "empty_one", "K", 6).count() == 0
