"""The dashboard's eight queries over result tables, and the envelopes they are served in.

Result tables carry stt, a window's start, as a timestamp or datetime string. Amounts are decimal(20,2)."""

from __future__ import annotations

import datetime
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KEYWORD_WEIGHTS, OTHER_KEYWORD_WEIGHT
from ..functions.time import on_day

MONEY = "decimal(20,2)"


def today() -> int:
    return int(datetime.datetime.now(datetime.UTC).strftime("%Y%m%d"))


def of_day(stats: DataFrame, date: int = 0) -> DataFrame:
    """Rows of a day, yyyyMMdd; 0 is today. Tables written by day are read for that day alone."""
    date = date or today()
    rows = stats.filter(on_day(F.col("stt").cast("timestamp"), date))
    return rows.filter(F.col("dt") == date) if "dt" in stats.columns else rows


def gmv(products: DataFrame, date: int = 0) -> DataFrame:
    return of_day(products, date).agg(F.sum("order_amount").cast(MONEY).alias("gmv"))


def _top(products: DataFrame, date: int, limit: int, name: str, **also: str) -> DataFrame:
    sums = [F.sum("order_amount").cast(MONEY).alias("order_amount"), *(F.sum(c).cast("bigint").alias(k) for k, c in also.items())]
    # A limit is the feature; ties go by name, so the answer is one of those the unordered original may give.
    return of_day(products, date).groupBy(F.col(name).alias("name")).agg(*sums).orderBy(F.desc("order_amount"), "name").limit(limit)


def gmv_by_brand(products: DataFrame, date: int = 0, limit: int = 5) -> DataFrame:
    return _top(products, date, limit, "tm_name")


def gmv_by_spu(products: DataFrame, date: int = 0, limit: int = 5) -> DataFrame:
    return _top(products, date, limit, "spu_name")


def gmv_by_category(products: DataFrame, date: int = 0, limit: int = 5) -> DataFrame:
    return _top(products, date, limit, "category3_name", order_ct="order_ct")


def province_totals(provinces: DataFrame, date: int = 0) -> DataFrame:
    return of_day(provinces, date).groupBy("province_name").agg(F.sum("order_amount").cast(MONEY).alias("order_amount"), F.sum("order_count").cast("bigint").alias("order_count"))


VISITS = ["uv_ct", "pv_ct", "sv_ct", "uj_ct"]


def visitor_by_hour(visitors: DataFrame, date: int = 0) -> DataFrame:
    """All 24 hours, zero where nobody came."""
    found = of_day(visitors, date).groupBy(F.hour(F.col("stt").cast("timestamp")).alias("h")).agg(*(F.sum(c).alias(c) for c in VISITS))
    hours = visitors.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    met = hours.join(found, F.col("hour") == F.col("h"), "left")
    return met.select(F.lpad(F.col("hour").cast("string"), 2, "0").alias("hour"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in VISITS))


def visitor_by_is_new(visitors: DataFrame, date: int = 0) -> DataFrame:
    return of_day(visitors, date).groupBy("is_new").agg(*(F.sum(c).cast("bigint").alias(c) for c in VISITS))


def keyword_score(keywords: DataFrame, date: int = 0, search_weight: int = OTHER_KEYWORD_WEIGHT) -> DataFrame:
    """Weighted counts. Searches are written as 'search', which has no weight of its own; search_weight gives it one."""
    weight = F.lit(OTHER_KEYWORD_WEIGHT)
    for source, w in {"search": search_weight, **KEYWORD_WEIGHTS}.items():
        weight = F.when(F.col("source") == source, w).otherwise(weight)
    return of_day(keywords, date).groupBy("keyword").agg(F.sum(F.col("ct") * weight).cast("bigint").alias("score"))


def _envelope(data) -> str:
    return json.dumps({"status": 0, "msg": "", "data": data}, ensure_ascii=False, default=float)


def scalar_response(df: DataFrame) -> str:
    return _envelope(df.first()[0])


def series_response(df: DataFrame, category: str, series: dict[str, str]) -> str:
    rows = df.collect()  # a limit or the day's hours bound it
    return _envelope({"categories": [r[category] for r in rows], "series": [{"name": name, "data": [r[c] for r in rows]} for name, c in series.items()]})


def pairs_response(df: DataFrame, name: str, value: str) -> str:
    return _envelope([{"name": r[name], "value": r[value]} for r in df.collect()])


def map_response(df: DataFrame, name: str, value: str, tooltip: Sequence[str]) -> str:
    return _envelope({"mapData": [{"name": r[name], "value": r[value], "tooltipValues": [r[c] for c in tooltip]} for r in df.collect()], "valueName": value, "tooltipNames": list(tooltip)})


def table_response(df: DataFrame, columns: dict[str, str]) -> str:
    rows = df.collect()
    return _envelope({"total": len(rows), "columns": [{"id": c, "name": n} for c, n in columns.items()], "rows": [{c: r[c] for c in columns} for r in rows]})


#: Endpoint -> response from the result tables it reads, a date and a limit.
ENDPOINTS = {
    "gmv": lambda t, date, limit: scalar_response(gmv(t["product"], date)),
    "tm": lambda t, date, limit: series_response(gmv_by_brand(t["product"], date, limit), "name", {"order_amount": "order_amount"}),
    "spu": lambda t, date, limit: pairs_response(gmv_by_spu(t["product"], date, limit), "name", "order_amount"),
    "c3": lambda t, date, limit: table_response(gmv_by_category(t["product"], date, limit), {"name": "category", "order_amount": "amount", "order_ct": "orders"}),
    "province": lambda t, date, limit: map_response(province_totals(t["province"], date), "province_name", "order_amount", ["order_count"]),
    "visitor": lambda t, date, limit: series_response(visitor_by_hour(t["visitor"], date).orderBy("hour"), "hour", {"uv": "uv_ct", "pv": "pv_ct"}),
    "visitor_is_new": lambda t, date, limit: table_response(visitor_by_is_new(t["visitor"], date), {"is_new": "is_new", "uv_ct": "uv"}),
    "kw": lambda t, date, limit: pairs_response(keyword_score(t["keyword"], date), "keyword", "score"),
}


def serve(endpoint: str, tables: dict[str, DataFrame], date: int = 0, limit: int = 5) -> str:
    return ENDPOINTS[endpoint](tables, date, limit)
