"""Times: epoch milliseconds, datetime strings and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DATETIME


def to_ms(text: Column, fmt: str = DATETIME) -> Column:
    """Epoch milliseconds of a datetime string; 0 where it can't be read, null for null."""
    return F.when(text.isNotNull(), F.coalesce(F.unix_millis(F.try_to_timestamp(text, F.lit(fmt))), F.lit(0)))


def from_ms(ms: Column, fmt: str = DATETIME) -> Column:
    return F.date_format(F.timestamp_millis(ms), fmt)


def event_time(ms: Column, seconds: bool = False) -> Column:
    """A timestamp; seconds=True cuts milliseconds off."""
    return F.timestamp_seconds(F.floor(ms / 1000)) if seconds else F.timestamp_millis(ms)


def day_of(ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(ms))


def day_number(ts: Column) -> Column:
    """A date as yyyyMMdd."""
    return F.date_format(ts, "yyyyMMdd").cast("int")


def day_start(day: int) -> Column:
    return F.to_timestamp(F.lit(str(day)), "yyyyMMdd")


def on_day(ts: Column, day: int) -> Column:
    """Whether ts lies on the day yyyyMMdd; a range, which a scan can use where ts is a stored column and no expression."""
    return (ts >= day_start(day)) & (ts < day_start(day) + F.expr("interval 1 day"))


def age_on(birthday: Column, as_of: Column) -> Column:
    """Years of 365 days."""
    return F.floor(F.datediff(as_of, birthday) / 365).cast("int")


def window_text(window: Column) -> list[Column]:
    """A window's bounds as datetime strings: stt, edt."""
    return [F.date_format(window["start"], DATETIME).alias("stt"), F.date_format(window["end"], DATETIME).alias("edt")]
