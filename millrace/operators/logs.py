"""Application logs: parsing, repair of the new-visitor mark, split into start, page and display logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LOG, MAP


def parse_log(raw: DataFrame, value: str = "value") -> DataFrame:
    return raw.select(F.from_json(value, LOG).alias("r")).select("r.*")


def parsed_once(topic: DataFrame, schema: str) -> DataFrame:
    """A topic (value, ...) with the fields of schema. As a generator, or the planner parses a line again in each filter that it moves down to it."""
    return topic.select("*", F.inline(F.array(F.from_json("value", schema))))


#: More than twice the distance of a tie of 64 bits from zero, so packed pairs sort as pairs.
PACK = 2 * 10**19


def packed(ts: str, tie: str) -> Column:
    """(ts, tie), both whole numbers, as one decimal of fixed width that sorts as they do: least and greatest rows are then
    found by a hash aggregate, where a struct takes a sort of all rows."""
    return F.col(ts).cast("decimal(18,0)") * F.lit(str(PACK)).cast("decimal(20,0)") + F.col(tie).cast("decimal(20,0)")


def repair_is_new(logs: DataFrame, key: Column | str = "mid", ts: str = "ts", tie: str = "arrival", out: str = "is_new") -> DataFrame:
    """`out` is '1' for a key's first row by (ts, tie), whole numbers, and '0' for all others.

    First rows come from an aggregation that tasks begin before the exchange; the join that follows is on two plain
    exchanges, so a key that holds much of the log can be split over tasks.
    """
    name = F.col(key) if isinstance(key, str) else key
    keyed = logs.withColumns({"__key": name.cast("string"), "__at": packed(ts, tie)})
    first = keyed.groupBy("__key").agg(F.min("__at").alias("__first"))
    met = keyed.join(first, "__key", "left")
    return met.withColumn(out, F.when(F.col("__at") == F.col("__first"), "1").otherwise("0")).drop("__key", "__at", "__first")


def start_logs(logs: DataFrame) -> DataFrame:
    return logs.filter("start IS NOT NULL")


def page_logs(logs: DataFrame) -> DataFrame:
    return logs.filter("start IS NULL AND page IS NOT NULL")


def display_logs(logs: DataFrame) -> DataFrame:
    """A row a display: its fields, then ts, the common ones and page_id; of equal names the later wins."""
    shown = logs.filter("start IS NULL AND displays IS NOT NULL").select("common", "page", "ts", F.explode("displays").alias("display"))
    return shown.select(put_all(F.col("display"), of_displays()).alias("display"), "ts")


def of_displays() -> Column:
    """What is put into each display of a row: ts, the common ones, page_id."""
    common = F.coalesce(F.col("common"), F.create_map().cast(MAP))
    stamped = F.when(F.map_contains_key(common, "ts"), common).otherwise(F.map_concat(F.create_map(F.lit("ts"), F.col("ts").cast("string")), common))
    return put(stamped, "page_id", F.col("page")["page_id"])


def put(to: Column, name: str, value: Column) -> Column:
    """A map with one entry put into it."""
    rest = F.map_filter(F.coalesce(to, F.create_map().cast(MAP)), lambda k, _: k != name)
    return F.map_concat(rest, F.create_map(F.lit(name), value))


def put_all(to: Column, entries: Column) -> Column:
    """A map with the entries of another put into it."""
    none = F.create_map().cast("map<string,string>")
    to, entries = F.coalesce(to, none), F.coalesce(entries, none)
    return F.map_concat(F.map_filter(to, lambda k, v: ~F.map_contains_key(entries, k)), entries)


def split_lines(logs: DataFrame) -> DataFrame:
    """What `split_log` gives as lines in one pass: (topic, value), topic 'start', 'page' or 'display'."""
    none = F.array().cast(f"array<{MAP}>")
    shown = F.coalesce(F.when(F.col("start").isNull(), F.col("displays")), none)
    # What a row's displays share is made once, before they are dealt out.
    shared = F.when(F.size(shown) > 0, of_displays()).alias("__shared")
    rows = logs.select("*", shared, shown.alias("__shown")).select("*", F.posexplode(F.concat(F.array(F.lit(None).cast(MAP)), F.col("__shown"))).alias("__at", "display"))
    own = F.col("__at") == 0
    topic = F.when(~own, "display").when(F.col("start").isNotNull(), "start").when(F.col("page").isNotNull(), "page")
    value = F.when(own, F.to_json(F.struct("common", "start", "page", "displays", "ts"))).otherwise(F.to_json(put_all(F.col("display"), F.col("__shared"))))
    return rows.select(topic.alias("topic"), value.alias("value")).filter("topic IS NOT NULL")


def split_log(logs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Start logs stand alone; a page log with displays gives both. Rows with none of them vanish."""
    return start_logs(logs), page_logs(logs), display_logs(logs)
