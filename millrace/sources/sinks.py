"""Sinks: topics, routed topics, result tables and keyed upserts; each for batches, and as a stream's batch function."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import CHECKPOINT_TRIGGER, TRANSIENT
from . import files
from .versions import Versions


def as_json(df: DataFrame) -> DataFrame:
    """(value): each row as JSON without its nulls."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def committed(spark: SparkSession, at: str, write: Callable[[str], None]) -> None:
    """The folder `at` with what write(path) leaves, whole and once: it is written aside, where no reader looks, and put in place
    by one rename. Where it is there already, its batch has run before, and readers may have taken it up: it stays as it is."""
    if files.exists(spark, at):
        return
    parent, _, name = at.rpartition("/")
    write(f"{parent}/_staged-{name}")
    files.rename(spark, f"{parent}/_staged-{name}", at)


def write_topic(df: DataFrame, root: str, name: str, batch: int | None = None) -> None:
    """Rows as JSON lines. With a stream's batch number they are committed as that batch: a batch that runs again, stopped before
    or behind its commit, leaves each row once for readers of the topic, those that follow it as a stream included."""
    write_lines(as_json(df), root, name, batch)


def write_lines(values: DataFrame, root: str, name: str, batch: int | None) -> None:
    """Rows (value) to a topic."""
    if batch is None:
        values.write.mode("append").text(f"{root}/{name}")
    else:
        committed(values.sparkSession, f"{root}/{name}/batch={batch}", lambda to: values.write.mode("overwrite").text(to))


def write_topics(lines: DataFrame, root: str, topics: dict[str, str], batch: int) -> None:
    """Rows (topic, value) of a batch, read once, to the topics that `topics` gives for their names. A batch is committed topic by topic:
    one that runs again adds those that it had not come to."""
    spark, at = lines.sparkSession, {name: f"{root}/{to}/batch={batch}" for name, to in topics.items()}
    if all(files.exists(spark, to) for to in at.values()):
        return
    staged = f"{root}/_staged/{'-'.join(topics)}-{batch}"
    lines.write.mode("overwrite").partitionBy("topic").text(staged)
    for name, to in at.items():
        if not files.exists(spark, to):
            if files.exists(spark, f"{staged}/topic={name}"):
                files.rename(spark, f"{staged}/topic={name}", to)
            else:
                files.mark(spark, f"{to}/_SUCCESS")
    files.delete(spark, staged)


def write_routed(routed: DataFrame, root: str, batch: int | None = None) -> None:
    """Rows (sink_table, data) to the topic that each names; a topic's rows may come from several tasks. A batch is committed
    topic by topic: one that runs again adds the topics that it had not come to."""
    rows, spark = routed.select("sink_table", F.to_json("data").alias("value")), routed.sparkSession
    if batch is None:
        rows.write.mode("append").partitionBy("sink_table").text(f"{root}/routed")
        return
    staged = f"{root}/routed/_staged-{batch}"
    rows.write.mode("overwrite").partitionBy("sink_table").text(staged)
    for topic in (n for n in files.names(spark, staged) if n.startswith("sink_table=")):
        if not files.exists(spark, f"{root}/routed/{topic}/batch={batch}"):
            files.rename(spark, f"{staged}/{topic}", f"{root}/routed/{topic}/batch={batch}")
    files.delete(spark, staged)


def read_routed(spark: SparkSession, root: str, sink_table: str) -> DataFrame:
    return spark.read.text(f"{root}/routed/sink_table={sink_table}").select("value")


def write_table(df: DataFrame, root: str, name: str, mode: str = "append", day: str | None = "stt", batch: int | None = None) -> None:
    """A result table without transient columns, by day where it has a window start, so a day's query reads that day. With a
    stream's batch number it is a ResultTable: a batch counts once, and days of many batches are merged. A stream's windows are
    written once, when they close, so that no two batches have rows of one key."""
    kept, by = df.drop(*(c for c in TRANSIENT if c in df.columns)), []
    if batch is not None:
        ResultTable(df.sparkSession, f"{root}/{name}", day if day in kept.columns else None).append(kept, batch)
        return
    if day and day in kept.columns:
        kept, by = kept.withColumn("dt", F.date_format(F.col(day).cast("timestamp"), "yyyyMMdd").cast("int")), ["dt"]
    kept.write.mode(mode).partitionBy(*by).parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A result table, with its day as dt; what a stream wrote counts by its lists."""
    held = ResultTable(spark, f"{root}/{name}")
    return held.read() if held.exists() else spark.read.parquet(f"{root}/{name}")


class ResultTable(Versions):
    """A stream's result table: a part a batch and day, in folders batch=N/dt=D, put in place by one rename a batch. Days with more
    than `most` parts are merged into one part (batch=-N, N the last batch), in files of some `file_mb`, before the list names it in
    their place; so a day has a bounded number of files however long the stream runs, and readers see either the parts or what they
    were merged to."""

    def __init__(self, spark: SparkSession, path: str, day: str | None = "stt", most: int = 24, file_mb: int = 128, keep_seconds: int = 3600):
        super().__init__(spark, path, keep_seconds)
        self.day, self.most, self.file_mb = day, most, file_mb

    def append(self, rows: DataFrame, batch: int) -> None:
        """A batch; nothing if it is there already."""
        lists = self._lists()
        held, last = self._listed(lists[-1]) if lists else ([], -1)
        if batch <= last:
            return
        staged, at = f"{self.path}/_staged-{batch}", f"batch={batch}"
        if self.day:
            # A day's rows go to one task, or to several if they are many: one file a day and not one a day and task.
            rows = rows.withColumn("dt", F.date_format(F.col(self.day).cast("timestamp"), "yyyyMMdd").cast("int")).hint("rebalance", "dt")
        rows.write.mode("overwrite").partitionBy(*(["dt"] if self.day else [])).parquet(staged)
        parts = [f"{at}/{n}" for n in files.names(self.spark, staged) if n.startswith("dt=")] if self.day else [at]
        files.delete(self.spark, f"{self.path}/{at}")  # of a batch that didn't come to its list
        files.rename(self.spark, staged, f"{self.path}/{at}")
        now = max(lists, default=0) + 1
        self._commit(now, [*held, *parts], batch)
        self._merge(now, [*held, *parts], batch)

    def _merge(self, version: int, held: list[str], batch: int) -> None:
        by_day: dict[str, list[str]] = {}
        for part in held:
            by_day.setdefault(part.partition("/")[2], []).append(part)
        many = {d: parts for d, parts in by_day.items() if len(parts) > self.most}
        if not many:
            return
        kept = [p for d, parts in by_day.items() if d not in many for p in parts]
        for d, parts in many.items():
            to = f"batch=-{batch}/{d}".rstrip("/")
            size = sum(files.size(self.spark, f"{self.path}/{p}") for p in parts)
            rows = self.spark.read.option("mergeSchema", True).parquet(*(f"{self.path}/{p}" for p in parts))
            rows.repartition(1 + size // (self.file_mb << 20)).write.mode("overwrite").parquet(f"{self.path}/{to}")
            kept.append(to)
        self._commit(version + 1, kept, batch)

    def read(self, version: int | None = None) -> DataFrame:
        parts = [f"{self.path}/{f}" for f in self.folders(version)]
        if not parts:
            raise FileNotFoundError(f"{self.path} has no rows yet")
        return self.spark.read.option("basePath", self.path).parquet(*parts)


class OpenWindows(Versions):
    """Rows (et, ...) of a stream's windows until they close: in files, in one folder that each batch replaces, where a keyed store
    would take and give them one by one. A window closes once, when the latest time met is `delay_ms` behind its end; rows of windows
    that were closed before their batch drop. The folder's name has the latest time met."""

    def __init__(self, spark: SparkSession, path: str, window: str, delay_ms: int):
        super().__init__(spark, path)
        self.window, self.delay_ms = window, delay_ms

    def take(self, rows: DataFrame, batch: int, closed: Callable[[DataFrame], None]) -> None:
        """A batch, read once; the rows of windows that it closes go to `closed`, which takes a batch that runs again for the same."""
        lists = self._lists()
        held, last = self._listed(lists[-1]) if lists else ([], -1)
        if batch <= last:
            return
        before = int(held[0].rpartition("-")[2]) if held else 0
        staged = f"{self.path}/_staged-{batch}"
        rows.write.mode("overwrite").parquet(staged)
        read = lambda *paths: self.spark.read.schema(rows.schema).parquet(*paths)
        now = max(before, read(staged).agg(F.unix_millis(F.max("et"))).first()[0] or 0)
        end = F.unix_millis(F.col("__w")["end"])
        pending = read(staged, *(f"{self.path}/{f}" for f in held)).withColumn("__w", F.window("et", self.window)).filter(end > before - self.delay_ms)
        shut, at = end <= now - self.delay_ms, f"b{batch:08d}-{now}"
        closed(pending.filter(shut).drop("__w"))
        pending.filter(~shut).drop("__w").write.mode("overwrite").parquet(f"{self.path}/{at}")
        self._commit(max(lists, default=0) + 1, [at], batch)
        files.delete(self.spark, staged)


class OpenRows(Versions):
    """Rows (ts, ...) of a stream until what may follow them is known: in files, in one folder that each batch replaces, whose name has
    the latest time met. A row is due when that is `delay_ms` behind its time and `within_ms`; rows that came when what the latest time
    is `delay_ms` behind of was met already are late, and drop."""

    def __init__(self, spark: SparkSession, path: str, within_ms: int, delay_ms: int):
        super().__init__(spark, path)
        self.within_ms, self.delay_ms = within_ms, delay_ms

    def take(self, rows: DataFrame, batch: int, decide: Callable[[DataFrame, Column], None]) -> None:
        """A batch. decide(pending, due) takes all rows that wait, with the order in which they came as `arrival`, and which of them
        are due; for a batch that runs again it takes the same."""
        lists = self._lists()
        held, last = self._listed(lists[-1]) if lists else ([], -1)
        if batch <= last:
            return
        rows = rows.persist()  # its latest time is asked for first
        try:
            before = int(held[0].rpartition("-")[2]) if held else 0
            now = max(before, rows.agg(F.max("ts")).first()[0] or 0)
            fresh = rows.filter(F.greatest("ts", F.lit(1)) > before - self.delay_ms)
            fresh = fresh.withColumn("arrival", F.struct(F.lit(batch).cast("bigint").alias("batch"), F.monotonically_increasing_id().alias("place")))
            pending = self.spark.read.schema(fresh.schema).parquet(*(f"{self.path}/{f}" for f in held)).unionByName(fresh) if held else fresh
            due, at = F.col("ts") + self.within_ms <= now - self.delay_ms, f"b{batch:08d}-{now}"
            decide(pending, due)
            pending.filter(~due).write.mode("overwrite").parquet(f"{self.path}/{at}")
            self._commit(max(lists, default=0) + 1, [at], batch)
        finally:
            rows.unpersist()


def insert_select(df: DataFrame, view: str, table: str, query: str) -> None:
    """INSERT INTO table query, where the query reads df by the name of view."""
    df.createOrReplaceTempView(view)
    df.sparkSession.sql(f"INSERT INTO {table} {query}")


def print_stream(df: DataFrame, checkpoint: str, rows: int = 20, available_now: bool = False) -> StreamingQuery:
    """A stream to the console, `rows` of each batch."""
    writer = df.writeStream.format("console").option("numRows", rows).option("truncate", False).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=CHECKPOINT_TRIGGER)).start()


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by `order`."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


#: Where a created table's clause says into how many parts it is salted.
SALTED = re.compile(r"SALT_BUCKETS\s*=\s*(\d+)", re.IGNORECASE)


def buckets_of(extend: str | None, default: int = 16) -> int:
    """The number of buckets that the clause of a created table asks for; what else it says is for other stores."""
    found = SALTED.search(extend or "")
    return max(1, int(found[1])) if found else default


class UpsertTable(Versions):
    """A keyed table in buckets. An upsert writes the buckets it touches, anew, as a new version, so it costs those buckets and
    readers see a whole version whenever a writer fails. Values are kept as strings where as_text is set. The number of buckets is
    fixed by the first upsert."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], as_text: bool = False, buckets: int = 16, keep_seconds: int = 0):
        super().__init__(spark, path, keep_seconds)
        self.keys, self.as_text, self.buckets = list(keys), as_text, buckets

    @staticmethod
    def _bucket_of(folder: str) -> int:
        return int(folder.rpartition("=")[2])

    def _holders(self, version: int) -> dict[int, str | None]:
        """bucket -> the folder that holds it, None where it is empty; as many entries as there are buckets."""
        listed = self._listed(version)[0]
        count = max((int(f.partition("/")[0].rpartition("-")[2]) for f in listed), default=self.buckets)
        return dict.fromkeys(range(count)) | {self._bucket_of(f): f for f in listed}

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.folders(version))

    def _read(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.path}/{f}" for f in sorted(folders)))

    def _bucket(self, count: int):
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in self.keys)), F.lit(count)).cast("int")

    def _same(self, one: str, two: str) -> list:
        return [F.col(f"{one}.{k}").eqNullSafe(F.col(f"{two}.{k}")) for k in self.keys]

    def upsert(self, rows: DataFrame, order: str, batch: int | None = None) -> None:
        """Rows of a known key replace the old one, of several the last by `order`; columns new to the table are added. With a
        stream's batch number a batch that is there already changes nothing."""

        def replaced(old: DataFrame, fresh: DataFrame) -> DataFrame:
            kept = old.alias("o").join(fresh.select(*self.keys).alias("n"), on=self._same("o", "n"), how="left_anti")
            return kept.unionByName(fresh, allowMissingColumns=True)

        self._write(latest(rows, self.keys, order).drop(order), replaced, batch)

    def add(self, rows: DataFrame, sums: Sequence[str], batch: int) -> None:
        """Rows of a known key add their sums to what is held, so a key's result follows its rows from batch to batch; a batch that
        is there already adds nothing. rows: keys and sums. This is a running aggregate whose state is the table."""
        totals = [F.sum(c).alias(c) for c in sums]
        fresh = rows.groupBy(*self.keys).agg(*totals)
        self._write(fresh, lambda old, new: old.select(*self.keys, *sums).unionByName(new).groupBy(*self.keys).agg(*(F.sum(c).cast(new.schema[c].dataType).alias(c) for c in sums)), batch)

    def _write(self, fresh: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None) -> None:
        lists = self._lists()
        last = self._listed(lists[-1])[1] if lists else -1
        if batch is not None and batch <= last:
            return
        holders = self._holders(lists[-1]) if lists else dict.fromkeys(range(self.buckets))
        if self.as_text:
            fresh = fresh.select(*(F.col(c).cast("string").alias(c) for c in fresh.columns))
        fresh = fresh.persist()  # as many rows as keys; what it is made of is read once
        try:
            bucket = self._bucket(len(holders))
            touched = {r[0] for r in fresh.select(bucket).distinct().collect()}  # as many as there are buckets
            if not touched and (batch is None or not lists):
                return
            version = max(lists, default=0) + 1
            at = f"v{version:08d}-{len(holders)}"
            if touched:
                held = [holders[b] for b in sorted(touched) if holders[b]]
                rows = merged(self._read(held), fresh) if held else fresh
                rows.withColumn("__bucket", bucket).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/{at}")
            after = {b: f"{at}/__bucket={b}" if b in touched else f for b, f in holders.items()}
            self._commit(version, [f for f in after.values() if f], last if batch is None else batch)
        finally:
            fresh.unpersist()

    def changes_of(self, batch: int) -> DataFrame:
        """The changes that a batch made, however often it has run."""
        lists = {v: self._listed(v)[1] for v in self._lists()}
        until = min(v for v, b in lists.items() if b >= batch)
        return self.changes(max((v for v, b in lists.items() if b < batch), default=0), until)

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """What a reader of version `since` (0: of nothing) has to take back and to take up to be at `until` (the version in
        force): the columns with op '-U' and '+U' for a changed row, '+I' for a new one, '-D' for one that is gone. Only buckets that
        another version holds are read."""
        new, old = set(self.folders(until)), set(self.folders(since)) if since else set()
        fresh = self._read(new - old or new)
        if not old - new:  # buckets filled for the first time, or none at all
            return (fresh if new - old else fresh.filter("false")).withColumn("op", F.lit("+I"))
        held, columns = self._read(old - new), fresh.columns
        for c in (c for c in columns if c not in held.columns):
            held = held.withColumn(c, F.lit(None).cast(fresh.schema[c].dataType))
        met = held.select(F.struct(*columns).alias("o"), *self.keys).alias("a").join(fresh.select(F.struct(*columns).alias("n"), *self.keys).alias("b"), self._same("a", "b"), "full_outer")
        met = met.filter(~F.col("o").eqNullSafe(F.col("n")))
        steps = F.array(F.struct(F.when(F.col("n").isNull(), "-D").otherwise("-U").alias("op"), F.col("o").alias("r")), F.struct(F.when(F.col("o").isNull(), "+I").otherwise("+U").alias("op"), F.col("n").alias("r")))
        return met.select(F.explode(F.filter(steps, lambda s: s["r"].isNotNull())).alias("s")).select("s.r.*", "s.op")


def run_stream(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", available_now: bool = False) -> StreamingQuery:
    """A stream into a batch function, checkpointed; available_now ends it when what is there is read."""
    writer = df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=CHECKPOINT_TRIGGER)).start()
