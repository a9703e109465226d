"""Stateful processors for what has no declarative form on a stream: new-visitor repair, unique visitors, bounces.

A null arrival counts the visitor's rows as they come.

Rows wait in state until event time passes them, and are then taken in order of (ts, arrival), so results don't depend on
the order of arrival. On a stream visitors are dealt to PARTS, whose state is one: see `process`. State needs the RocksDB
provider: see `configure`."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import BOUNCE_WITHIN_MS, DAY_MS, WINDOW_MS


#: State beyond memory: the stores of an executor share one bounded cache, which has room for the filters of their files (a
#: store's own of 8 MB reads them again for each key), and rows aren't counted, which would look up each key once more.
STATE = {
    "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "rocksdb.boundedMemoryUsage": "true", "rocksdb.maxMemoryUsageMB": "600",
    "rocksdb.trackTotalNumberOfRows": "false", "rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> None:
    for name, value in STATE.items():
        spark.conf.set(f"spark.sql.streaming.stateStore.{name}", value)


#: Rows of one visitor that came together, as one value: state is asked for values, and each costs a call to the JVM.
ROWS = T.StructType([T.StructField("ts", T.ArrayType(T.LongType())), T.StructField("arrival", T.ArrayType(T.LongType())), T.StructField("entry", T.ArrayType(T.BooleanType())), T.StructField("body", T.ArrayType(T.StringType()))])
FLAG = T.StructType([T.StructField("value", T.LongType())])
#: Rows met, and the timer that is set, 0 for none.
BOOK = T.StructType([T.StructField("met", T.LongType()), T.StructField("timer", T.LongType())])

#: How many rows one value has at most.
AT_ONCE = 4096

COLUMNS = ["ts", "arrival", "body", "flag"]


class _Waiting(StatefulProcessor):
    """Keeps rows until the watermark has passed `due(row)`, then hands them on in order.

    A visitor has one timer, set to when the first of the rows that wait is due, so a batch costs a few calls a visitor and not
    several a row. A row is late, and drops, by its own time. slack_ms: the watermark stays so far behind, so that rows drop only
    where what they belong to is closed; what is due by time less the delay is due as if it weren't."""

    slack_ms = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", ROWS)
        self.mark = handle.getValueState("mark", FLAG)
        self.book = handle.getValueState("book", BOOK)

    def due(self, ts: int) -> int:
        """When a row can be decided."""
        raise NotImplementedError

    def at_once(self) -> bool:
        """Whether the rows to come are decided already, with flag '0'."""
        return False

    def decide(self, ready: list[tuple], rest: list[tuple]) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.at_once():
            for frame in rows:
                yield pd.DataFrame({"ts": frame["ts"], "arrival": frame["arrival"].fillna(0).astype("int64"), "body": frame["body"], "flag": "0"}, columns=COLUMNS)
            return
        n, timer = self.book.get() or (0, 0)
        first = timer
        for frame in rows:
            ts, arrival = frame["ts"].astype("int64").tolist(), frame["arrival"]
            came = [n + k + 1 if none else int(at) for k, (at, none) in enumerate(zip(arrival, arrival.isna(), strict=True))]
            n += len(ts)
            self._keep(self.rows.appendValue, ts, came, frame["entry"].astype(bool).tolist(), frame["body"].tolist())
            first = min(first or self._timer(min(ts)), self._timer(min(ts)))
        if timer and first < timer:
            self.handle.deleteTimer(timer)
        if first != timer:
            self.handle.registerTimer(first)
        self.book.update((n, first))

    def _timer(self, ts: int) -> int:
        return max(1, self.due(ts) - self.slack_ms)

    def _keep(self, put, *columns: list) -> None:
        for k in range(0, len(columns[0]), AT_ONCE):
            put(tuple(c[k : k + AT_ONCE] for c in columns))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Decides all that the watermark has passed, and sets the timer of the first row of the rest."""
        until = timerValues.getCurrentWatermarkInMs() + self.slack_ms
        held = sorted((r for rows in self.rows.get() for r in zip(*rows, strict=True)), key=lambda r: (r[0], r[1]))
        ready = [r for r in held if self.due(r[0]) <= until]
        kept, out = self.decide(ready, held[len(ready) :]) if ready else (held, [])
        if ready:
            self.rows.clear()
            if kept:
                self._keep(self.rows.appendValue, *map(list, zip(*kept, strict=True)))
        timer = self._timer(kept[0][0]) if kept else 0
        if timer:
            self.handle.registerTimer(timer)
        self.book.update((self.book.get()[0], timer))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def decide_all(self, held: pa.Table, until: int, of: Callable[[str], _Waiting]) -> tuple[pa.Table, pd.DataFrame]:
        """The same for many visitors, whose rows (HELD) are in order of (mid, ts, arrival): rows that stay, and what leaves. `of`
        takes up a visitor's mark. Here one visitor after the other."""
        mids, *columns = (c.to_pylist() for c in held.columns)
        rest, out = [], []
        for mid, line in groupby(zip(mids, zip(*columns, strict=True), strict=True), key=lambda r: r[0]):
            line = [r for _, r in line]
            due = bisect_right(line, until, key=lambda r: self.due(r[0]))
            kept, decided = of(mid).decide(line[:due], line[due:]) if due else (line, [])
            rest += [(mid, *r) for r in kept]
            out += decided
        return pa.table(list(map(list, zip(*rest, strict=True))) or [[]] * len(HELD), HELD), pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def _starts(held: pa.Table) -> np.ndarray:
    """Whether a row is its visitor's first."""
    mid = held["mid"].combine_chunks()
    return np.concatenate([[True], pc.not_equal(mid[1:], mid[:-1]).to_numpy(zero_copy_only=False)])


class NewVisitorProcessor(_Waiting):
    """flag '1' for a visitor's first row, '0' for others. Rows wait until the window of the first one closes; a visitor who is
    known by then has a time in state and no rows, and rows to come leave as they are met."""

    window_ms = slack_ms = WINDOW_MS

    def at_once(self) -> bool:
        return self.mark.exists()

    def due(self, ts: int) -> int:
        return ts // self.window_ms * self.window_ms + self.window_ms

    def decide(self, ready, rest):
        self.mark.update((ready[0][0],))
        return [], [(ts, arrival, body, "0" if k else "1") for k, (ts, arrival, _, body) in enumerate([*ready, *rest])]

    def decide_all(self, held, until, of):
        starts = _starts(held)
        ready = self.due(held["ts"].to_numpy()[starts]) <= until
        for mid, ts in zip(*(held[c].filter(pa.array(starts)).filter(pa.array(ready)).to_pylist() for c in ("mid", "ts")), strict=True):
            of(mid).mark.update((ts,))
        leaves = ready[np.cumsum(starts) - 1]
        return held.filter(pa.array(~leaves)), _frame(held.filter(pa.array(leaves)), np.where(starts[leaves], "1", "0"))


class UniqueVisitorProcessor(NewVisitorProcessor):
    """The first row of a closed window if the visitor was not met yet, or last on another day than the window's end."""

    decide_all = _Waiting.decide_all

    def at_once(self) -> bool:
        return False

    def decide(self, ready, rest):
        out, last, before = [], self.mark.get(), None
        for ts, arrival, _, body in ready:
            end = self.due(ts)
            if end != before and (last is None or last[0] // DAY_MS != end // DAY_MS):
                last = (ts,)
                out.append((ts, arrival, body, "1"))
            before = end
        if out:
            self.mark.update(last)
        return rest, out


class BounceProcessor(_Waiting):
    """Entries that are followed by an entry, or by nothing within the time."""

    within_ms = BOUNCE_WITHIN_MS["v2"]
    entries_end = True

    def due(self, ts: int) -> int:
        return ts + self.within_ms

    def decide(self, ready, rest):
        out, line = [], ready + rest
        for k, (ts, arrival, entry, body) in enumerate(ready):
            after = line[k + 1] if k + 1 < len(line) else None
            if entry and (after is None or after[0] - ts >= self.within_ms or self.entries_end and after[2]):
                out.append((ts, arrival, body, "1"))
        return rest, out

    def decide_all(self, held, until, of):
        ts, entry, starts = held["ts"].to_numpy(), held["entry"].to_numpy(), _starts(held)
        ready, last = self.due(ts) <= until, np.append(starts[1:], True)
        ends = last | (np.append(ts[1:], 0) - ts >= self.within_ms)
        if self.entries_end:
            ends |= np.append(entry[1:], False)
        return held.filter(pa.array(~ready)), _frame(held.filter(pa.array(ready & entry & ends)), "1")


class LateBounceProcessor(BounceProcessor):
    """Entries that are followed by nothing within the time (v1)."""

    within_ms = BOUNCE_WITHIN_MS["v1"]
    entries_end = False


class _MarkOf:
    """A visitor's mark among those of its part."""

    def __init__(self, marks, mid: str):
        self.marks, self.key = marks, (mid,)

    def get(self) -> tuple | None:
        return self.marks.getValue(self.key)

    def exists(self) -> bool:
        return self.marks.containsKey(self.key)

    def update(self, value: tuple) -> None:
        self.marks.updateValue(self.key, value)


#: Waiting rows of a part that came together, in Arrow's stream format: state takes a value's bytes as they are, where lists are
#: converted item by item.
BYTES = T.StructType([T.StructField("rows", T.BinaryType())])
MID = T.StructType([T.StructField("mid", T.StringType())])
HELD = pa.schema([("mid", pa.string()), ("ts", pa.int64()), ("arrival", pa.int64()), ("entry", pa.bool_()), ("body", pa.string())])

#: To how many parts visitors are dealt; fixed as long as a checkpoint is.
PARTS = 2048
#: Rows met, the timer that is set, 0 for none, and the watermark of the last call, up to which a part may be decided.
PART_BOOK = T.StructType([*BOOK.fields, T.StructField("until", T.LongType())])


def _bytes_of(rows: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD, options=pa.ipc.IpcWriteOptions(compression="lz4")) as to:
        to.write(rows)
    return sink.getvalue().to_pybytes()


def _rows_of(values: Iterable[bytes]) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(v).read_all() for v in values).combine_chunks()


def _frame(rows: pa.Table, flag: str | np.ndarray) -> pd.DataFrame:
    """Rows that leave; bodies stay Arrow's."""
    body = pd.Series(rows["body"].combine_chunks(), dtype=pd.ArrowDtype(pa.string()))
    return pd.DataFrame({"ts": rows["ts"].to_numpy(), "arrival": rows["arrival"].to_numpy(), "body": body, "flag": flag}, columns=COLUMNS)


class Dealt(StatefulProcessor):
    """A processor of single visitors for parts of many, whose rows wait together: a batch costs calls to the state by parts, not by
    visitors. Marks stay a visitor's own, so a part's known visitors cost nothing until they come again."""

    def __init__(self, one: _Waiting):
        self.one = one

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", BYTES)
        self.marks = handle.getMapState("marks", MID, FLAG)
        self.book = handle.getValueState("book", PART_BOOK)

    def _of(self, mid: str) -> _Waiting:
        self.one.mark = _MarkOf(self.marks, mid)
        return self.one

    def _keep(self, rows: pa.Table) -> None:
        for batch in rows.combine_chunks().to_batches(max_chunksize=AT_ONCE):
            self.rows.appendValue((_bytes_of(batch),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._take(pa.concat_tables(pa.Table.from_pandas(f[HELD.names], HELD, preserve_index=False) for f in rows), 0)

    def _take(self, rows: pa.Table, watermark: int) -> Iterator[pd.DataFrame]:
        """Rows that came, without those that are no later than the watermark of the part's last call."""
        n, timer, until = self.book.get() or (0, 0, 0)
        first = timer
        rows = rows.filter(pa.array(np.maximum(rows["ts"].to_numpy(), 1) > until))
        came, given = np.arange(n + 1, n + 1 + len(rows)), rows["arrival"].is_valid().to_numpy()
        came[given] = rows["arrival"].drop_null().to_numpy()
        n += len(rows)
        rows = rows.set_column(2, HELD.field("arrival"), pa.array(came))
        known = [mid for mid in rows["mid"].unique().to_pylist() if self._of(mid).at_once()]
        if known:
            met = pc.is_in(rows["mid"], pa.array(known, pa.string()))
            yield _frame(rows.filter(met), "0")
            rows = rows.filter(pc.invert(met))
        if len(rows):
            self._keep(rows)
            at = self.one._timer(int(rows["ts"].to_numpy().min()))
            first = min(first or at, at)
        if timer and first < timer:
            self.handle.deleteTimer(timer)
        if first != timer:
            self.handle.registerTimer(first)
        self.book.update((n, first, max(until, watermark)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = _rows_of(bytes(v[0]) for v in self.rows.get()).sort_by([(c, "ascending") for c in HELD.names[:3]])
        rest, out = self.one.decide_all(held, watermark + self.one.slack_ms, self._of)
        timer = 0
        # A part whose rows all stay keeps them as they are.
        if len(rest) < len(held):
            self.rows.clear()
        if len(rest):
            if len(rest) < len(held):
                self._keep(rest)
            timer = self.one._timer(int(rest["ts"].to_numpy().min()))
            self.handle.registerTimer(timer)
        n, _, until = self.book.get()
        self.book.update((n, timer, max(until, watermark)))
        if len(out):
            yield out

    def close(self) -> None:
        pass


class Packed(Dealt):
    """The same for rows that come packed, many of a part as one value: Spark hands a group's rows to Python one by one."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._take(_rows_of(v for f in rows for v in f["rows"]), timerValues.getCurrentWatermarkInMs())


#: How many bytes of rows a task packs at once.
PACK_BYTES = 64 << 20


def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (HELD, part) of a task, in order -> (part, at, rows): rows of a part as one value, and their latest time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PACK_BYTES:
            yield _packs(held)
            held, size = [], 0
    if held:
        yield _packs(held)


def _packs(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).combine_chunks()
    order = np.argsort(rows["part"].to_numpy(), kind="stable")
    rows = rows.take(pa.array(order))
    part, ts = rows["part"].to_numpy(), rows["ts"].to_numpy()
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    rows = rows.select(HELD.names).cast(HELD)
    values = [_bytes_of(rows.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(part)], strict=True)]
    at = np.maximum.reduceat(ts, starts) if len(starts) else ts
    return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), pa.array(at, pa.int64()), pa.array(values, pa.binary())], ["part", "at", "rows"])


OUT = "ts bigint, arrival bigint, body string, flag string"


def process(pages: DataFrame, processor: _Waiting, delay: str) -> DataFrame:
    """pages (mid, ts, arrival, entry, body), a stream -> (ts, arrival, body, flag). Visitors are dealt to parts by a hash."""
    dealt = pages.select(*HELD.names, F.pmod(F.xxhash64("mid"), F.lit(PARTS)).cast("int").alias("part"))
    packs = dealt.mapInArrow(pack, "part int, at bigint, rows binary")
    # The first watermark is the epoch, and what isn't behind it is late. A pack is late if all of it is.
    timed = packs.withColumn("et", F.timestamp_millis(F.greatest("at", F.lit(1)))).withWatermark("et", f"{delay} {processor.slack_ms} milliseconds")
    return timed.groupBy("part").transformWithStateInPandas(statefulProcessor=Packed(processor), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def in_parts(processor: type[_Waiting], **own: int) -> _Waiting:
    """A processor with other widths."""
    return type(processor.__name__, (processor,), own)()
