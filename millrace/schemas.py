"""Record types of the layers, as DDL text."""

from __future__ import annotations

MAP = "map<string,string>"
MONEY = "decimal(20,2)"

LOG = f"common {MAP}, start {MAP}, page {MAP}, displays array<{MAP}>, ts bigint"
BINLOG = f"database string, `table` string, type string, ts bigint, data {MAP}"
ROUTE = "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string, sink_extend string"
ORDER_INFO = (
    f"id bigint, province_id bigint, order_status string, user_id bigint, total_amount {MONEY}, activity_reduce_amount {MONEY}, "
    f"coupon_reduce_amount {MONEY}, original_total_amount {MONEY}, feight_fee {MONEY}, expire_time string, create_time string, operate_time string"
)
ORDER_DETAIL = (
    f"id bigint, order_id bigint, sku_id bigint, order_price {MONEY}, sku_num bigint, sku_name string, create_time string, "
    f"split_total_amount {MONEY}, split_activity_amount {MONEY}, split_coupon_amount {MONEY}"
)
PAYMENT_INFO = f"id bigint, order_id bigint, user_id bigint, total_amount {MONEY}, subject string, payment_type string, create_time string, callback_time string"
FAVOR_INFO = CART_INFO = "sku_id bigint, create_time string"
REFUND_INFO = f"sku_id bigint, order_id bigint, refund_amount {MONEY}, create_time string"
COMMENT_INFO = "sku_id bigint, appraise string, create_time string"
