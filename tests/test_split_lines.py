"""Logs are split in one pass, and come to the state step packed."""

import json
import types

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.operators import logs
from millrace.plans import streams
from millrace.plans.samples import Samples
from millrace.schemas import LOG
from millrace.sources import sinks
from millrace.sources.topics import read_topic
from millrace.streaming import jobs, processors

from .test_dealt_visitors import HeldParts

SMALL = "/root/testdata/sf0.001"


def test_lines_are_those_of_the_three_logs(spark):
    docs = [{"common": {"mid": "a"}, "start": {"x": "y"}, "displays": [{"item": "1"}], "ts": 1}, {"common": {"mid": "a"}, "page": {"page_id": "p"}, "displays": [{"item": "1", "ts": "0"}, None], "ts": 2}, {"page": {"page_id": "q"}, "displays": []}, {"displays": [{"item": "3"}], "ts": 4}, {"ts": 5}]
    parsed = logs.parsed_once(spark.createDataFrame([(json.dumps(d),) for d in docs], "value string"), LOG).drop("value").persist()
    start, page, display = logs.split_log(parsed)
    want = [("start", r[0]) for r in sinks.as_json(start).collect()] + [("page", r[0]) for r in sinks.as_json(page).collect()] + [("display", r[0]) for r in display.select(F.to_json("display")).collect()]
    assert sorted(tuple(r) for r in logs.split_lines(parsed).collect()) == sorted(want) and len(want) == 6
    parsed.unpersist()


def test_topics_of_a_batch_are_committed_once_and_read_once(spark, tmp_path):
    root, met = str(tmp_path), spark.sparkContext.accumulator(0)
    lines = spark.range(9).rdd.map(lambda r: (met.add(1), ("b" if r.id % 3 else "a", str(r.id)))[1]).toDF("topic string, value string")
    names = {"a": "first", "b": "second", "c": "none"}
    sinks.write_topics(lines, root, names, 0)
    assert met.value == 9
    import shutil

    shutil.rmtree(f"{root}/second/batch=0")  # as if it had been killed there
    for _ in range(2):
        sinks.write_topics(lines, root, names, 0)
    assert [read_topic(spark, root, t).count() for t in names.values()] == [3, 6, 0] and met.value == 18


def test_the_state_step_takes_packs_and_not_rows(spark):
    t = streams.Topics(Samples(spark, SMALL))
    t.put(t.s.pages, jobs.TOPICS["log"], t.closing(), streams.as_logs)
    plan = jobs.marked_logs(spark, t.root)._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and plan.index("TransformWithState") < plan.index("MapInArrow")


def packs(rows):
    frame = pd.DataFrame(rows, columns=["mid", "ts", "body"]).assign(arrival=None, entry=False, part=[len(r[0]) for r in rows])
    schema = pa.schema([*processors.HELD, ("part", pa.int32())])
    return list(processors.pack(pa.Table.from_pandas(frame[schema.names], schema, preserve_index=False).to_batches(max_chunksize=2)))


def test_packs_have_all_rows_of_a_part_in_order_and_their_latest_time():
    (got,) = packs([("a", 5, "0"), ("bb", 9, "1"), ("a", 3, "2"), ("c", 7, "3"), ("bb", 1, "4")])
    assert [(r["part"], r["at"], processors._rows_of([r["rows"]])["body"].to_pylist()) for r in got.to_pylist()] == [(1, 7, ["0", "2", "3"]), (2, 9, ["1", "4"])]
    assert list(processors.pack(iter([]))) == []


def test_a_late_row_of_a_pack_that_is_not_late_drops():
    held, one = HeldParts(), processors.Packed(processors.NewVisitorProcessor())
    one.init(held)
    at = lambda ms: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    put = lambda ms, *rows: [r for f in one.handleInputRows((1,), iter([pd.DataFrame({"rows": [r["rows"] for b in packs(rows) for r in b.to_pylist()]})]), at(ms)) for r in f["body"]]
    assert put(0, ("a", 1000, "first"), ("b", 90_000, "later")) == []
    out = [tuple(r) for f in one.handleExpiredTimer((1,), at(50_000), None) for r in f[["body", "flag"]].itertuples(index=False)]
    assert out == [("first", "1")]
    assert put(60_000, ("a", 50_000, "late"), ("a", 50_001, "known"), ("c", 49_000, "late too"), ("d", 70_000, "new")) == ["known"]
    assert sorted(processors._rows_of(v[0] for v in held.values["rows"])["body"].to_pylist()) == ["later", "new"]
