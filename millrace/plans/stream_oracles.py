"""SQL for DuckDB that gives the rows of the stream queries."""

from __future__ import annotations

from .oracles import DAY_OF, ITEMS, LAST_WINDOW, MONEY, ORACLES, PAGES, REPAIRED, VISITORS, bounced, first_rows


def within(sql: str, ms: int) -> str:
    """A bounce query with another time."""
    return sql.replace("21600000", str(ms))


STREAM_ORACLES = {
    "stream_split_logs": f"WITH {REPAIRED} SELECT mid, ts, is_new FROM repaired WHERE page_id NOT IN ('signup', 'error')",
    "stream_unique_visitors": f"WITH {PAGES} SELECT mid, ts FROM ({first_rows('pages', f'mid, {DAY_OF}, {LAST_WINDOW}')})",
    "stream_bounces_v1": within(f"WITH {PAGES} SELECT mid, ts FROM ({bounced('pages', 'v1')})", 20_000),
    "stream_bounces_v2": within(f"WITH {PAGES} SELECT mid, ts FROM ({bounced('pages', 'v2')})", 5_000),
    "stream_visitor_stats": within(f"WITH {VISITORS} SELECT * FROM visitors", 5_000),
    "stream_keyword_stats": ORACLES["keyword_stats"],
    "stream_routes": """SELECT CASE n_nationkey % 5 WHEN 1 THEN 'dim_nation' ELSE 'dwd_nation' END AS sink_table, CAST(n_nationkey AS VARCHAR) AS n_nationkey, CASE n_nationkey % 5 WHEN 1 THEN NULL ELSE n_name END AS n_name
        FROM nation WHERE n_nationkey % 5 < 3 AND n_nationkey <> 7""",
    "upsert_table": f"WITH {PAGES} SELECT mid, page_id FROM pages QUALIFY row_number() OVER (PARTITION BY mid ORDER BY arrival DESC) = 1",
    "insert_select": "SELECT event_type AS page_id, count(*) AS visits FROM events GROUP BY 1",
    "order_wide_six_dims": """SELECT l_orderkey * 10 + l_linenumber AS detail_id, o_orderkey AS order_id, CAST(floor(date_diff('day', DATE '1990-01-01' + CAST(c_custkey % 1000 AS INTEGER), DATE '2021-05-28') / 365) AS INTEGER) AS user_age,
        c_mktsegment AS user_gender, n_name AS province_name, p_partkey * 2 AS spu_id, p_name AS spu_name, CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT) AS tm_id, p_brand AS tm_name,
        CAST(p_size AS BIGINT) AS category3_id, 'size ' || p_size AS category3_name
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate - INTERVAL 5 day AND o_orderdate + INTERVAL 5 day
        LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey""",
    "product_prices": f"""WITH {ITEMS} SELECT sku_id, any_value(p_name) AS spu_name, CAST(any_value(p_retailprice) AS {MONEY}) AS sku_price, CAST(sum(amount) AS {MONEY}) AS order_amount, count(DISTINCT order_id) AS order_ct
        FROM items LEFT JOIN part ON sku_id = p_partkey WHERE CAST(et AS DATE) = DATE '1996-01-15' GROUP BY 1""",
}
