"""Topics as folders of JSON lines, read as a batch or as a stream; tables and literal rows; log ingest.

There is no message broker on the class path here. A topic is a folder below a root, whose files the stream source takes up
once each; `kafka_topic` reads the same shape where the connector is there."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: How many files of a topic a stream takes up in a batch.
MAX_FILES = "spark.millrace.maxFilesPerTrigger"


def read_topic(spark: SparkSession, root: str, name: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """(value) of a topic, of what is committed there. max_files: as the session's MAX_FILES, or 64."""
    if streaming:
        max_files = max_files or int(spark.conf.get(MAX_FILES, "64"))
        return spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(f"{root}/{name}").select("value")
    return spark.read.text(f"{root}/{name}").select("value")


def read_topics(spark: SparkSession, root: str, names: Iterable[str], streaming: bool = False) -> dict[str, DataFrame]:
    return {name: read_topic(spark, root, name, streaming) for name in names}


def kafka_topic(spark: SparkSession, servers: str, name: str) -> DataFrame:
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", name)
    return stream.option("startingOffsets", "latest").option("kafka.isolation.level", "read_committed").load().selectExpr("CAST(value AS STRING) AS value")


def as_table(topic: DataFrame, schema: T.StructType | str, name: str, time: F.Column | None = None, delay: str | None = None) -> DataFrame:
    """Parses a topic's JSON and registers it as a temporary view, with the time column `et` and its watermark."""
    rows = topic.select(F.from_json("value", schema).alias("r")).select("r.*")
    if time is not None:
        rows = rows.withColumn("et", time)
        if delay:
            rows = rows.withWatermark("et", delay)
    rows.createOrReplaceTempView(name)
    return rows


def _asked(spark: SparkSession, url: str, query: str, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def key_ranges(spark: SparkSession, url: str, table: str, key: str, parts: int, cells: int = 64, **options: str) -> list[str]:
    """Predicates that cut a whole-number key into at most `parts` ranges of about as many rows. The database counts rows in
    cells of equal width; a cell with more rows than a range should have is counted again in finer cells, until ranges are even or
    keys are single. Rows without a key go with the first range."""
    low, high, total = _asked(spark, url, f"SELECT MIN({key}) AS lo, MAX({key}) AS hi, COUNT({key}) AS n FROM {table}", options).first()
    if not total:
        return ["1 = 1"]
    goal, todo, counted = -(-int(total) // parts), [(int(low), int(high))], []
    while todo:
        a, b = todo.pop()
        width = max(1, -(-(b - a + 1) // (cells * parts)))
        sql = f"SELECT cell, COUNT(*) AS n FROM (SELECT ({key} - ({a})) / {width} AS cell FROM {table} WHERE {key} BETWEEN {a} AND {b}) t GROUP BY cell"
        for cell, n in (tuple(r) for r in _asked(spark, url, sql, options).collect()):  # cells * parts rows at most
            start = a + int(cell) * width
            if n > goal and width > 1:
                todo.append((start, min(b, start + width - 1)))
            else:
                counted.append((start, int(n)))
    bounds, held = [], 0
    for start, n in sorted(counted):
        if held and held + n > goal:
            bounds.append(start)
            held = 0
        held += n
    edges = [None, *bounds, None]
    out = [" AND ".join(filter(None, (a is not None and f"{key} >= {a}", b is not None and f"{key} < {b}"))) or "1 = 1" for a, b in zip(edges, edges[1:], strict=False)]
    return [f"({out[0]} OR {key} IS NULL)", *out[1:]]


def read_jdbc(spark: SparkSession, url: str, source: str, key: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A query, read by one task; or a table by ranges of its whole-number key, a task a range."""
    if key is None:
        return _asked(spark, url, source, options)
    return spark.read.jdbc(url, source, predicates=key_ranges(spark, url, source, key, parts, **options), properties=options)


def lookup_jdbc(spark: SparkSession, url: str, table: str, key: str, wanted: DataFrame, most: int = 10_000, at_once: int = 500, **options: str) -> DataFrame:
    """The rows of a table whose whole-number key is among `wanted` (its first column). Up to `most` keys are sent to the database,
    at_once a query; with more the table is read by ranges and joined."""
    keys = wanted.select(F.col(wanted.columns[0]).cast("bigint").alias("wanted")).filter("wanted IS NOT NULL").distinct()
    found = sorted(r.wanted for r in keys.limit(most + 1).collect())
    if len(found) > most:
        rows = read_jdbc(spark, url, table, key, **options)
        return rows.join(keys, rows[key] == keys["wanted"], "left_semi")
    lists = [f"{key} IN ({', '.join(map(str, found[k : k + at_once]))})" for k in range(0, len(found), at_once)]
    return spark.read.jdbc(url, table, predicates=lists or ["1 = 0"], properties=options)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def ingest_log(spark: SparkSession, root: str, lines: Iterable[str], topic: str = "ods_log") -> None:
    """Appends collected lines to the log topic and to a log folder by day."""
    rows = spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1)
    rows.write.mode("append").text(f"{root}/{topic}")
    day = datetime.datetime.now(datetime.UTC).date().isoformat()
    rows.write.mode("append").text(f"{root}/_daily/{day}/{uuid.uuid4().hex}")
