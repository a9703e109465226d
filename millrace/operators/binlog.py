"""Change-capture rows: filter, and routing by configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import BINLOG


def parse_binlog(raw: DataFrame, value: str = "value") -> DataFrame:
    return raw.select(F.from_json(value, BINLOG).alias("r")).select("r.*")


def etl_binlog(changes: DataFrame) -> DataFrame:
    """Complete rows whose type holds `insert` or `update` and whose data, as JSON text, is longer than 10."""
    whole = F.col("database").isNotNull() & F.col("table").isNotNull() & F.col("type").isNotNull() & F.col("data").isNotNull()
    kind = F.col("type").contains("insert") | F.col("type").contains("update")
    return changes.filter(whole & kind & (F.length(F.to_json("data")) > 10))


def operation(kind: Column) -> Column:
    return F.regexp_replace(kind, "bootstrap-", "")


def pruned(data: Column, sink_columns: Column) -> Column:
    """The entries that sink_columns names, exactly as split at commas: blanks count."""
    names = F.split(sink_columns, ",")
    return F.map_filter(data, lambda k, v: F.array_contains(names, k))


def merged_routes(changes: DataFrame, sticky: bool = False) -> DataFrame:
    """The routes in force after a sequence of configuration changes (a route's columns, op in '+I', '+U', '-U', '-D', seq).

    sticky: deletions don't count, so a route stays until it is replaced."""
    seen = changes.filter(F.col("op").isin("+I", "+U")) if sticky else changes.filter("op <> '-U'")
    last = seen.groupBy("source_table", "operate_type").agg(F.max_by(F.struct("*"), "seq").alias("r"))
    return last.select("r.*").filter("op <> '-D'").drop("op", "seq")


#: The configuration table's columns as its change feed names them.
FEED_NAMES = {"sourceTable": "source_table", "operateType": "operate_type", "sinkType": "sink_type", "sinkTable": "sink_table", "sinkColumns": "sink_columns", "sinkPk": "sink_pk", "sinkExtend": "sink_extend"}


def feed_routes(feed: DataFrame) -> DataFrame:
    """A change feed of the configuration, its columns named as routes are."""
    return feed.withColumnsRenamed(FEED_NAMES)


def route_versions(changes: DataFrame, sticky: bool = False) -> DataFrame:
    """The routes of a sequence of configuration changes with the time each was in force, [since, until): its own ts to the next
    change's of the same table and operation (seq settles equal times; null: for good). Rows that took a route away end the one
    before, or nothing if sticky. A window over the configuration alone."""
    seen = feed_routes(changes).filter(F.col("op").isin("+I", "+U") if sticky else F.col("op") != "-U")
    by = Window.partitionBy("source_table", "operate_type").orderBy("ts", "seq")
    lasting = seen.withColumn("until", F.lead("ts").over(by)).withColumnRenamed("ts", "since")
    return lasting.filter("op <> '-D' AND (until IS NULL OR until > since)").drop("op", "seq")


def route_as_of(changes: DataFrame, config: DataFrame, ts: str = "ts", keep: Sequence[str] = (), sticky: bool = False) -> DataFrame:
    """route() by the configuration as it stood at each row's own time; rows without a time go by what holds for good. config:
    as for route_versions. An equi-join on table and operation whose residual is the time, so a table that holds most of the
    rows is split by the planner, and rows of no route drop."""
    return route(changes, route_versions(config, sticky), keep, ts)


def route(changes: DataFrame, routes: DataFrame, keep: Sequence[str] = (), ts: str | None = None) -> DataFrame:
    """(sink_type, sink_table, sink_pk, sink_extend, data): rows with a route, their columns pruned; others drop.

    keep: further columns of changes, such as their order. ts: the column of their time, where routes have times."""
    times = [F.col("since").alias("__since"), F.col("until").alias("__until")] if ts else []
    by = routes.select(F.col("source_table"), F.col("operate_type"), F.lower("sink_type").alias("sink_type"), "sink_table", "sink_columns", "sink_pk", "sink_extend", *times)
    on = (F.col("table") == by["source_table"]) & (F.col("__op") == by["operate_type"])
    if ts:
        at = F.col(ts)
        on &= F.when(at.isNull(), F.col("__until").isNull()).otherwise((at >= F.col("__since")) & (F.col("__until").isNull() | (at < F.col("__until"))))
    met = changes.withColumn("__op", operation(F.col("type"))).join(by, on)
    return met.filter(F.col("sink_type").isin("kafka", "hbase")).select("sink_type", "sink_table", "sink_pk", "sink_extend", pruned(F.col("data"), F.col("sink_columns")).alias("data"), *keep)


def to_topics(routed: DataFrame) -> DataFrame:
    return routed.filter("sink_type = 'kafka'")


def to_dimensions(routed: DataFrame) -> DataFrame:
    return routed.filter("sink_type = 'hbase'")
