"""SQL for DuckDB that gives the rows of the sample queries."""

from __future__ import annotations

MONEY = "DECIMAL(20,2)"

PAGES = """pages AS (
  SELECT event_id AS arrival, CAST(user_id AS VARCHAR) AS mid, epoch_us(ts) // 1000 AS ts, ts AS et, event_type AS page_id,
         CASE WHEN event_type NOT IN ('signup', 'view') THEN 'home' END AS last_page_id, event_type AS ch,
         regexp_extract(props, '"k": ([0-9]+)', 1) AS ar, CAST(floor(value) AS BIGINT) AS during_time,
         'item ' || regexp_extract(props, '"k": ([0-9]+)', 1) AS item
  FROM events)"""

REPAIRED = PAGES + """, repaired AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY mid ORDER BY ts, arrival) = 1 THEN '1' ELSE '0' END AS is_new FROM pages)"""

DAY_OF = "ts // 86400000"
LAST_WINDOW = "((ts // 5000) * 5000 + 5000) // 86400000 > ts // 86400000"


def first_rows(source: str, keys: str) -> str:
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY ts, arrival) = 1"


def bounced(source: str, variant: str) -> str:
    alone = "n IS NULL OR n - ts >= 21600000" + (" OR next_last IS NULL" if variant == "v2" else "")
    return f"""SELECT * FROM (SELECT *, lead(ts) OVER w AS n, lead(last_page_id) OVER w AS next_last FROM {source} WINDOW w AS (PARTITION BY mid ORDER BY ts, arrival))
               WHERE last_page_id IS NULL AND ({alone})"""


def stamp(unit: str, column: str = "et") -> str:
    text = "'%Y-%m-%d %H:%M:%S'"
    return f"strftime(date_trunc('{unit}', {column}), {text}) AS stt, strftime(date_trunc('{unit}', {column}) + INTERVAL 1 {unit}, {text}) AS edt"


VISITORS = REPAIRED + f""", visitors AS (
  SELECT {stamp("hour")}, 'v1' AS vc, ch, ar, is_new, CAST(sum(uv) AS BIGINT) AS uv_ct, CAST(sum(pv) AS BIGINT) AS pv_ct, CAST(sum(sv) AS BIGINT) AS sv_ct,
         CAST(sum(uj) AS BIGINT) AS uj_ct, CAST(sum(dur) AS BIGINT) AS dur_sum, epoch_ms(date_trunc('hour', et) + INTERVAL 1 hour) AS ts
  FROM (SELECT et, ch, ar, is_new, 0 AS uv, 1 AS pv, CASE WHEN last_page_id IS NULL THEN 1 ELSE 0 END AS sv, 0 AS uj, during_time AS dur FROM repaired
        UNION ALL SELECT et, ch, ar, is_new, 1, 0, 0, 0, 0 FROM ({first_rows("repaired", f"mid, {DAY_OF}, {LAST_WINDOW}")})
        UNION ALL SELECT et, ch, ar, is_new, 0, 0, 0, 1, 0 FROM ({bounced("repaired", "v2")}))
  GROUP BY date_trunc('hour', et), ch, ar, is_new)"""

ITEMS = f"""items AS (
  SELECT l_shipdate AS et, l_partkey AS sku_id, l_orderkey AS order_id, CAST(l_quantity AS BIGINT) AS num, CAST(l_extendedprice AS {MONEY}) AS amount, l_returnflag AS flag, l_linestatus AS status
  FROM lineitem)"""

PRODUCT_ROWS = f"""{PAGES}, {ITEMS}, product_rows AS (
  SELECT et, sku_id, 0 AS display, 0 AS click, 0 AS favor, 0 AS cart, num, amount, NULL AS paid, NULL AS refund, 0 AS comments, 0 AS good, order_id, NULL AS paid_id, NULL AS refund_id FROM items
  UNION ALL SELECT et, sku_id, 0, 0, 0, 0, 0, 0, amount, 0, 0, 0, NULL, order_id, NULL FROM items WHERE status = 'F'
  UNION ALL SELECT et, sku_id, 0, 0, 0, 0, 0, 0, 0, amount, 0, 0, NULL, NULL, order_id FROM items WHERE flag = 'R'
  UNION ALL SELECT et, sku_id, 0, 0, 0, 0, 0, 0, 0, 0, 1, CASE WHEN flag IN ('A', 'N') THEN 1 ELSE 0 END, NULL, NULL, NULL FROM items
  UNION ALL SELECT et, CAST(ar AS BIGINT), CASE WHEN page_id = 'view' THEN 1 ELSE 0 END, CASE WHEN page_id = 'click' THEN 1 ELSE 0 END, CASE WHEN page_id = 'signup' THEN 1 ELSE 0 END,
                   CASE WHEN page_id = 'purchase' THEN 1 ELSE 0 END, 0, 0, 0, 0, 0, 0, NULL, NULL, NULL FROM pages WHERE page_id <> 'error')"""

PRODUCTS = f"""{ITEMS}, products AS (
  SELECT CAST(et AS DATE) AS d, sku_id, sum(amount) AS order_amount, count(DISTINCT order_id) AS order_ct, any_value(p_brand) AS tm_name, any_value(p_name) AS spu_name, any_value(p_type) AS category3_name
  FROM items LEFT JOIN part ON sku_id = p_partkey GROUP BY 1, 2)"""

FACTS = f"""facts AS (
  SELECT o_orderdate AS et, CAST(c_nationkey AS BIGINT) AS province_id, n_name AS province_name, CAST(n_regionkey AS VARCHAR) AS area_code, CAST(l_extendedprice AS {MONEY}) AS amount, l_orderkey AS order_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""

PROVINCES = f"""WITH {FACTS} SELECT {stamp("day")}, province_id, province_name, area_code, CAST(sum(amount) AS {MONEY}) AS order_amount, count(DISTINCT order_id) AS order_count
  FROM facts GROUP BY date_trunc('day', et), province_id, province_name, area_code"""

KEYWORDS = f"""{PAGES}, words AS (SELECT date_trunc('day', et) AS d, page_id, unnest(['item', ar]) AS keyword FROM pages),
  searched AS (SELECT d, keyword, 'search' AS source, count(*) AS ct FROM words WHERE page_id = 'view' GROUP BY 1, 2),
  bought AS (SELECT d, keyword, CASE page_id WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'order' ELSE 'cart' END AS source, count(*) AS ct
             FROM words WHERE page_id IN ('click', 'purchase', 'signup') GROUP BY 1, 2, 3)"""


def top(name: str, also: str = "") -> str:
    return f"""WITH {PRODUCTS} SELECT {name} AS name, CAST(sum(order_amount) AS {MONEY}) AS order_amount{also} FROM products WHERE d = DATE '1996-01-15'
               GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""


VISITS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("uv_ct", "pv_ct", "sv_ct", "uj_ct"))

ORACLES = {
    "is_new_repair": f"WITH {REPAIRED} SELECT arrival, mid, is_new FROM repaired",
    "unique_visitors": f"WITH {PAGES} SELECT arrival, mid, ts FROM ({first_rows('pages', f'mid, {DAY_OF}, {LAST_WINDOW}')})",
    "unique_visitors_calendar": f"WITH {PAGES} SELECT arrival, mid, ts FROM ({first_rows('pages', f'mid, {DAY_OF}')})",
    "unique_visitors_lifetime": f"WITH {PAGES} SELECT arrival, mid, ts FROM ({first_rows('pages', 'mid')})",
    "bounces_v1": f"WITH {PAGES} SELECT arrival, mid, ts FROM ({bounced('pages', 'v1')})",
    "bounces_v2": f"WITH {PAGES} SELECT arrival, mid, ts FROM ({bounced('pages', 'v2')})",
    "log_split_start": f"WITH {PAGES} SELECT arrival, mid FROM pages WHERE page_id = 'signup'",
    "log_split_page": f"WITH {PAGES} SELECT arrival, page_id, item FROM pages WHERE page_id NOT IN ('signup', 'error')",
    "log_split_display": f"""WITH {PAGES} SELECT ts, concat('ar=', ar, ';ch=', ch, ';item=', i, ';item_type=', CASE i WHEN 0 THEN 'promotion' ELSE 'sku_id' END,
        ';mid=', mid, ';page_id=', page_id, ';pos=x;ts=common') AS display FROM pages, (VALUES (0), (1)) v(i) WHERE page_id IN ('view', 'purchase')""",
    "map_access": f"WITH {PAGES} SELECT arrival, item FROM pages WHERE page_id = 'view'",
    "etl_binlog": """SELECT 'nation' AS "table", CASE n_nationkey % 5 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'bootstrap-insert' END AS type,
        concat('n_name=', n_name, ';n_nationkey=', n_nationkey, ';secret=x') AS data FROM nation WHERE n_nationkey % 5 < 3 AND n_nationkey <> 7""",
    "route_prune": """SELECT CASE n_nationkey % 5 WHEN 1 THEN 'hbase' ELSE 'kafka' END AS sink_type, CASE n_nationkey % 5 WHEN 1 THEN 'dim_nation' ELSE 'dwd_nation' END AS sink_table,
        CASE n_nationkey % 5 WHEN 1 THEN concat('n_nationkey=', n_nationkey) ELSE concat('n_name=', n_name, ';n_nationkey=', n_nationkey) END AS data
        FROM nation WHERE n_nationkey % 5 < 3 AND n_nationkey <> 7""",
    "order_wide": f"""SELECT l_orderkey * 10 + l_linenumber AS detail_id, o_orderkey AS order_id, CAST(c_nationkey AS BIGINT) AS province_id, o_custkey AS user_id, CAST(o_totalprice AS {MONEY}) AS total_amount,
        l_partkey AS sku_id, CAST(l_quantity AS BIGINT) AS sku_num, CAST(l_extendedprice AS {MONEY}) AS split_total_amount, strftime(o_orderdate, '%Y-%m-%d') AS create_date, strftime(o_orderdate, '%H') AS create_hour,
        c_mktsegment AS user_gender, n_name AS province_name, r_name AS province_iso_code, p_name AS spu_name, p_brand AS tm_name, p_type AS category3_name
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate - INTERVAL 5 day AND o_orderdate + INTERVAL 5 day
        LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey""",
    "payment_wide": f"""SELECT l_orderkey * 10 + l_linenumber AS payment_id, o_orderkey AS order_id, l_suppkey AS user_id, CAST(l_extendedprice AS {MONEY}) AS total_amount, l_returnflag AS subject, l_linestatus AS payment_type,
        strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS payment_create_time, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_create_time, CAST(c_nationkey AS BIGINT) AS province_id, o_orderstatus AS order_status
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderdate BETWEEN l_shipdate - INTERVAL 45 day AND l_shipdate + INTERVAL 1 day LEFT JOIN customer ON o_custkey = c_custkey""",
    "visitor_stats": f"WITH {VISITORS} SELECT * FROM visitors",
    "product_stats": f"""WITH {PRODUCT_ROWS} SELECT {stamp("day")}, sku_id, CAST(sum(display) AS BIGINT) AS display_ct, CAST(sum(click) AS BIGINT) AS click_ct, CAST(sum(favor) AS BIGINT) AS favor_ct, CAST(sum(cart) AS BIGINT) AS cart_ct,
        CAST(sum(num) AS BIGINT) AS order_sku_num, CAST(sum(amount) AS {MONEY}) AS order_amount, CAST(coalesce(sum(paid), 0) AS {MONEY}) AS payment_amount, CAST(coalesce(sum(refund), 0) AS {MONEY}) AS refund_amount,
        CAST(sum(comments) AS BIGINT) AS comment_ct, CAST(sum(good) AS BIGINT) AS good_comment_ct, count(DISTINCT order_id) AS order_ct, count(DISTINCT paid_id) AS paid_order_ct, count(DISTINCT refund_id) AS refund_order_ct,
        min(epoch_us(et) // 1000) AS ts FROM product_rows GROUP BY date_trunc('day', et), sku_id""",
    "province_stats": PROVINCES,
    "province_stats_sql": PROVINCES,
    "keyword_stats": f"WITH {KEYWORDS} SELECT {stamp('day', 'd')}, keyword, source, ct FROM searched",
    "keyword_documents": "SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda t: t <> ''))) AS BIGINT) AS words FROM documents",
    "keyword_product": f"""WITH {PAGES} SELECT mid, CASE page_id WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'order' ELSE 'cart' END AS source, count(*) AS ct
        FROM pages WHERE page_id IN ('click', 'purchase', 'signup') GROUP BY 1, 2""",
    "keyword_product_stats": f"WITH {KEYWORDS} SELECT {stamp('day', 'd')}, keyword, source, ct FROM bought",
    "gmv": f"SELECT CAST(sum(CAST(l_extendedprice AS {MONEY})) AS {MONEY}) AS gmv FROM lineitem WHERE CAST(l_shipdate AS DATE) = DATE '1996-01-15'",
    "gmv_by_brand": top("tm_name"),
    "gmv_by_spu": top("spu_name"),
    "gmv_by_category": top("category3_name", ", CAST(sum(order_ct) AS BIGINT) AS order_ct"),
    "province_totals": f"""WITH {FACTS}, days AS (SELECT province_id, province_name, sum(amount) AS a, count(DISTINCT order_id) AS n FROM facts WHERE CAST(et AS DATE) = DATE '1996-01-15' GROUP BY ALL)
        SELECT province_name, CAST(sum(a) AS {MONEY}) AS order_amount, CAST(sum(n) AS BIGINT) AS order_count FROM days GROUP BY 1""",
    "visitor_by_hour": f"""WITH {VISITORS} SELECT lpad(CAST(h AS VARCHAR), 2, '0') AS hour, {VISITS} FROM range(24) r(h)
        LEFT JOIN (SELECT * FROM visitors WHERE stt LIKE '2024-01-15%') ON CAST(stt[12:13] AS BIGINT) = h GROUP BY h""",
    "visitor_by_is_new": f"WITH {VISITORS} SELECT is_new, {VISITS} FROM visitors WHERE stt LIKE '2024-01-15%' GROUP BY 1",
    "keyword_score": f"""WITH {KEYWORDS} SELECT keyword, CAST(sum(ct * CASE source WHEN 'source' THEN 10 WHEN 'click' THEN 8 WHEN 'order' THEN 5 ELSE 2 END) AS BIGINT) AS score
        FROM (SELECT * FROM searched UNION ALL SELECT * FROM bought) WHERE CAST(d AS DATE) = DATE '2024-01-15' GROUP BY 1""",
    "union_metrics": "SELECT CAST(user_id AS VARCHAR) AS mid, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS buys FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1",
    "upsert_latest": f"WITH {PAGES} SELECT mid, page_id, arrival FROM pages QUALIFY row_number() OVER (PARTITION BY mid ORDER BY arrival DESC) = 1",
    "time_functions": f"""WITH {PAGES} SELECT arrival, strftime(et, '%Y-%m-%d %H:%M:%S') AS at, (ts // 1000) * 1000 AS ms, CAST(0 AS BIGINT) AS bad_ms, strftime(et, '%H') AS hour, lpad(ar, 4, '0') AS padded,
        CAST(strftime(et, '%Y%m%d') AS INTEGER) AS day, upper(page_id) AS upper, coalesce(last_page_id, page_id) AS page FROM pages""",
    "coalesce_age": "SELECT o_orderkey, CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '2021-05-28') / 365) AS INTEGER) AS age FROM orders",
    "json_roundtrip": f"WITH {PAGES} SELECT arrival, mid, last_page_id, ts FROM pages",
}

ORACLES["product_stats_by_topic"] = ORACLES["product_stats"]
