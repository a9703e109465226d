"""Visits: unique visitors and bounced entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BOUNCE_WITHIN_MS, DAY_MS, WINDOW_MS
from .logs import packed


def is_entry(last_page: Column) -> Column:
    return F.coalesce(last_page, F.lit("")) == ""


def _groups(mode: str, ts: str, window_ms: int) -> dict[str, Column]:
    """By what besides the visitor a first row is looked for."""
    day = F.floor(F.col(ts) / DAY_MS)
    last = F.floor((F.floor(F.col(ts) / window_ms) * window_ms + window_ms) / DAY_MS) > day
    return {"lifetime": {}, "calendar_day": {"__day": day}, "reference": {"__day": day, "__last": last}}[mode]


def unique_visitors(pages: DataFrame, mode: str = "reference", key: str = "mid", ts: str = "ts", tie: str = "arrival", window_ms: int = WINDOW_MS) -> DataFrame:
    """A visitor's earliest page row by (ts, tie), whole numbers that no two rows of a visitor share: per day (calendar_day), ever
    (lifetime), or per day and once more if met in the day's last window, whose end is the next day (reference).

    The least place in time is one number, found by a hash aggregate that tasks begin before the exchange; rows with such a
    place stay, by a semi-join, so no column but those asked for is carried. Rows without a visitor are one visitor's."""
    groups = _groups(mode, ts, window_ms)
    placed = pages.withColumn("__at", packed(ts, tie))
    first = placed.groupBy(F.col(key).alias("__key"), *(c.alias(n) for n, c in groups.items())).agg(F.min("__at").alias("__first")).select("__key", "__first")
    return placed.join(first, placed[key].eqNullSafe(first["__key"]) & (placed["__at"] == first["__first"]), "left_semi").drop("__at")


def flagged(pages: DataFrame, counted: Column | None = None, within_ms: int | None = None, key: str = "mid", ts: str = "ts", tie: str = "arrival", last_page: str = "last_page_id", window_ms: int = WINDOW_MS, ever: DataFrame | None = None) -> DataFrame:
    """Pages with what visitor statistics ask of each: is_new '1' for a visitor's first row ever, uv 1 for one that counts as a
    unique visitor (reference mode), uj 1 for a bounced entry (v2). One aggregate and one join give both first rows.

    ever: the pages in which first rows ever are looked for, if pages are a part of them. counted: rows that are kept; others only
    follow them."""
    groups = _groups("reference", ts, window_ms)
    placed = bounce_marks(pages, "v2", within_ms, key, ts, tie, last_page).withColumns({"__at": packed(ts, tie), "__key": F.col(key).cast("string"), **groups})
    if counted is not None:
        placed = placed.filter(counted)
    days = pages.withColumns({"__at": packed(ts, tie), **groups}).groupBy(F.col(key).cast("string").alias("__of"), *(F.col(n).alias(f"{n}_") for n in groups)).agg(F.min("__at").alias("__first"))
    first = (days.groupBy(F.col("__of").alias("__one")).agg(F.min("__first").alias("__ever"))) if ever is None else ever.groupBy(F.col(key).cast("string").alias("__one")).agg(F.min(packed(ts, tie)).alias("__ever"))
    known = days.join(first, days["__of"].eqNullSafe(first["__one"]))
    met = placed.join(known, placed["__key"].eqNullSafe(known["__of"]) & (F.col("__day") == F.col("__day_")) & (F.col("__last") == F.col("__last_")), "left")
    flags = {"is_new": F.when(F.col("__at") == F.col("__ever"), "1").otherwise("0"), "uv": (F.col("__at") == F.col("__first")).cast("int"), "uj": F.col("__bounced").cast("int")}
    return met.withColumns(flags).select(*(c for c in pages.columns if c not in flags), *flags)


def bounces(pages: DataFrame, variant: str = "v2", within_ms: int | None = None, key: str = "mid", ts: str = "ts", tie: str = "arrival", last_page: str = "last_page_id", page: str = "page_id") -> DataFrame:
    """Entry pages that no other page follows in time.

    v2: the next row of the visitor is an entry, or comes within_ms later or not at all. v1: it comes within_ms later or
    not at all. Rows are dealt by visitor and stretch of time; a stretch also sees the first within_ms of the next one, all
    that a decision can depend on, so a visitor of very many rows is no task of its own.
    """
    return bounce_marks(pages, variant, within_ms, key, ts, tie, last_page).filter("__bounced").select(*pages.columns)


def bounce_marks(pages: DataFrame, variant: str, within_ms: int | None, key: str, ts: str, tie: str, last_page: str) -> DataFrame:
    """Pages, each with __bounced."""
    within = BOUNCE_WITHIN_MS[variant] if within_ms is None else within_ms
    stretch = 64 * within
    at = F.floor(F.col(ts) / stretch)
    early = F.col(ts) - at * stretch < within
    seen = F.filter(F.array(F.struct(at.alias("stretch"), F.lit(True).alias("own")), F.when(early, F.struct((at - 1).alias("stretch"), F.lit(False).alias("own")))), lambda s: s.isNotNull())
    rows = pages.withColumn("__seen", F.explode(seen)).withColumn("__entry", is_entry(F.col(last_page)))
    by = Window.partitionBy(F.col(key), F.col("__seen.stretch")).orderBy(ts, tie)
    rows = rows.withColumn("__next", F.lead(F.struct(F.col(ts).alias("ts"), F.col("__entry").alias("entry"))).over(by))
    alone = F.col("__next").isNull() | (F.col("__next.ts") - F.col(ts) >= within)
    if variant == "v2":
        alone = alone | F.col("__next.entry")
    return rows.filter("__seen.own").select(*pages.columns, (F.col("__entry") & alone).alias("__bounced"))
