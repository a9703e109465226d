"""Wide facts: orders with their details, payments with their orders; both by interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import age_on, to_ms
from .dims import DimSpec, join_dims


def with_create_parts(df: DataFrame) -> DataFrame:
    """create_date, create_hour and create_ts of create_time."""
    text = F.col("create_time")
    return df.withColumns({"create_date": F.substring(text, 1, 10), "create_hour": F.substring(text, 12, 2), "create_ts": to_ms(text)})


def interval_join(left: DataFrame, right: DataFrame, on: Column, left_time: Column, right_time: Column, before: str, after: str) -> DataFrame:
    """Pairs whose keys meet and whose right time lies from `before` before to `after` after the left; bounds included.

    The same condition serves streams that both have watermarks."""
    low, high = F.expr(f"INTERVAL {before}"), F.expr(f"INTERVAL {after}")
    return left.join(right, on & (right_time >= left_time - low) & (right_time <= left_time + high))


def order_wide(orders: DataFrame, details: DataFrame, before: str = "5 seconds", after: str = "5 seconds") -> DataFrame:
    """orders and details carry a timestamp `et`. Columns no source fills are null."""
    o, d = orders.alias("o"), details.alias("d")
    met = interval_join(o, d, F.col("o.id") == F.col("d.order_id"), F.col("o.et"), F.col("d.et"), before, after)
    own = ["province_id", "order_status", "user_id", "total_amount", "activity_reduce_amount", "coupon_reduce_amount", "original_total_amount", "feight_fee", "create_time", "create_date", "create_hour"]
    detail = ["sku_id", "order_price", "sku_num", "sku_name", "split_total_amount", "split_activity_amount", "split_coupon_amount"]
    return met.select(
        F.col("d.id").alias("detail_id"), F.col("o.id").alias("order_id"), *(F.col(f"o.{c}") for c in own), *(F.col(f"d.{c}") for c in detail),
        F.lit(None).cast("decimal(20,2)").alias("split_feight_fee"), F.lit(None).cast("string").alias("expire_time"), F.lit(None).cast("string").alias("operate_time"), F.col("o.et").alias("et"),
    )


def order_dims(users: DataFrame, provinces: DataFrame, skus: DataFrame, spus: DataFrame, brands: DataFrame, categories: DataFrame, as_of: Column) -> list[DimSpec]:
    """The six look-ups of an order; the last three by keys that the sku gives."""
    return [
        DimSpec(users, "user_id", {"user_age": age_on(F.col("birthday").cast("date"), as_of), "user_gender": "gender"}),
        DimSpec(provinces, "province_id", {"province_name": "name", "province_area_code": "area_code", "province_iso_code": "iso_code", "province_3166_2_code": "iso_3166_2"}),
        DimSpec(skus, "sku_id", {"spu_id": F.col("spu_id").cast("bigint"), "tm_id": F.col("tm_id").cast("bigint"), "category3_id": F.col("category3_id").cast("bigint")}),
        DimSpec(spus, "spu_id", {"spu_name": "spu_name"}),
        DimSpec(brands, "tm_id", {"tm_name": "tm_name"}),
        DimSpec(categories, "category3_id", {"category3_name": "name"}),
    ]


def widen(orders: DataFrame, details: DataFrame, specs: Sequence[DimSpec], before: str = "5 seconds", after: str = "5 seconds") -> DataFrame:
    return join_dims(order_wide(orders, details, before, after), specs)


def payment_wide(payments: DataFrame, wide: DataFrame, before: str = "45 minutes", after: str = "1 minute") -> DataFrame:
    """Order rows from `before` before to `after` after their payment. Of columns both have, the payment's stays."""
    p, w = payments.alias("p"), wide.alias("w")
    met = interval_join(p, w, F.col("p.order_id") == F.col("w.order_id"), F.col("p.et"), F.col("w.et"), before, after)
    taken = {"order_id", "user_id", "total_amount", "create_time", "et"}
    rest = [c for c in wide.columns if c not in taken]
    return met.select(
        F.col("p.id").alias("payment_id"), F.col("p.order_id"), F.col("p.user_id"), F.col("p.total_amount"), F.col("p.subject"), F.col("p.payment_type"), F.col("p.callback_time"),
        F.col("p.create_time").alias("payment_create_time"), F.col("w.create_time").alias("order_create_time"), *(F.col(f"w.{c}") for c in rest), F.col("p.et").alias("et"),
    )
