"""Names, codes, windows and delays of the warehouse."""

from __future__ import annotations

# Topics and tables of the layers.
TOPICS = {
    "log": "ods_log", "db": "ods_db", "start": "dwd_start_log", "page": "dwd_page_log", "display": "dwd_display_log",
    "unique_visitor": "dwm_uv", "bounce": "dwm_jump_detail", "order_wide": "dwm_order_wide", "payment_wide": "dwm_payment_wide",
    "order_info": "dwd_order_info", "order_detail": "dwd_order_detail", "payment_info": "dwd_payment_info",
    "favor_info": "dwd_favor_info", "cart_info": "dwd_cart_info", "refund_info": "dwd_order_refund_info", "comment_info": "dwd_comment_info",
    "product_stats": "dws_product_stats", "keyword_changes": "dws_keyword_changes",
}
RESULTS = {"visitor": "visitor_stats_2021", "product": "product_stats_2021", "province": "province_stats_2021", "keyword": "keyword_stats_2021"}
# Appraisals that count as good.
GOOD_REVIEWS = ("1205", "1204")
# Weights of keyword sources; the writer says 'search' where the weight is for 'source'.
KEYWORD_WEIGHTS = {"source": 10, "click": 8, "order": 5}
OTHER_KEYWORD_WEIGHT = 2

DATETIME = "yyyy-MM-dd HH:mm:ss"
WINDOW = "5 seconds"
WINDOW_MS = 5_000
DAY_MS = 86_400_000
BOUNCE_WITHIN_MS = {"v2": 5_000, "v1": 20_000}
DELAYS = {"default": "5 seconds", "bounce": "2 seconds", "keyword": "10 seconds", "province": "5 seconds", "visitor": "15 seconds"}
DELAY_MS = {k: 1000 * int(v.split()[0]) for k, v in DELAYS.items()}
CHECKPOINT_TRIGGER = "6 seconds"
#: Columns that wide rows carry for aggregation and no sink writes.
TRANSIENT = ("order_ids", "paid_order_ids", "refund_order_ids")
#: How long versions of dimension and result tables stay for those who read them.
KEEP_SECONDS = 3600
