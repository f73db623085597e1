"""SQL fragments shared by the counterparts of the registered queries."""

from __future__ import annotations

RAW_ORDERS = """raw_orders AS (
  SELECT l_orderkey AS order_id, o_custkey AS customer_id, l_partkey AS product_id,
    CAST(o_orderdate AS DATE) AS order_date,
    CASE WHEN (l_orderkey * 7 + l_linenumber) % 230 = 0 THEN -1 ELSE CAST(l_quantity AS INT) END AS quantity,
    CASE WHEN (l_orderkey * 11 + l_linenumber) % 940 = 0 THEN 'N/A'
      ELSE CAST(CAST(CAST(p_retailprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
        AS DECIMAL(18,4)) AS VARCHAR) END AS unit_price,
    o_orderpriority AS channel, CAST(l_shipdate AS DATE) AS ship_date, CAST(l_tax AS DECIMAL(4,2)) AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""
SILVER_ORDERS = (
    RAW_ORDERS
    + """, silver_orders AS (
  SELECT order_id, customer_id, product_id, order_date, CASE WHEN quantity > 0 THEN quantity END AS quantity,
    TRY_CAST(unit_price AS DECIMAL(18,4)) AS unit_price, channel, ship_date, tax
  FROM raw_orders
)"""
)
VALID = (
    SILVER_ORDERS
    + """, valid AS (
  SELECT *, CAST(quantity * unit_price AS DECIMAL(18,4)) AS revenue,
    CAST(date_trunc('week', order_date) AS DATE) AS week
  FROM silver_orders WHERE quantity IS NOT NULL AND unit_price IS NOT NULL
)"""
)
RAW_CUSTOMERS = """raw_customers AS (
  SELECT c_custkey AS customer_id, c_name AS name,
    CASE WHEN c_custkey % 33 <> 0 THEN 'c' || c_custkey || '@example.com' END AS email, n_name AS country,
    CAST(DATE '1995-01-01' + CAST(c_custkey * 37 % 365 AS INT) AS DATE) AS signup_date
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN (SELECT unnest([1, 2]) AS copy) ON copy = 1 OR c_custkey < 10
)"""
SILVER_CUSTOMERS = (
    RAW_CUSTOMERS
    + """, silver_customers AS (
  SELECT DISTINCT customer_id, name, COALESCE(email, 'unknown@unknown.com') AS email, country, signup_date
  FROM raw_customers
)"""
)
RAW_PRODUCTS = """raw_products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_retailprice AS list_price FROM part
)"""
SILVER_PRODUCTS = (
    RAW_PRODUCTS
    + """, silver_products AS (
  SELECT product_id, product_name,
    CASE WHEN category IN ('STANDARD', 'PROMO', 'LARGE', 'ECONOMY') THEN category ELSE 'Other' END AS category,
    list_price
  FROM raw_products
)"""
)
GOLD = f"""{VALID}, {SILVER_CUSTOMERS}, {SILVER_PRODUCTS}, weekly_sales AS (
  SELECT week, CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue, count(*) AS order_count,
    count(DISTINCT customer_id) AS unique_customers
  FROM valid GROUP BY week
), customer_metrics AS (
  SELECT c.customer_id, c.name, c.country, count(o.order_id) AS total_orders,
    CAST(round(sum(o.revenue), 2) AS DOUBLE) AS lifetime_value,
    floor(CAST(sum(o.revenue) AS DOUBLE) / count(o.revenue) * 100 + 0.5) / 100 AS avg_order_value
  FROM silver_customers c LEFT JOIN valid o ON c.customer_id = o.customer_id
  GROUP BY c.customer_id, c.name, c.country
), category_performance AS (
  SELECT p.category, CAST(round(sum(o.revenue), 2) AS DOUBLE) AS revenue, count(*) AS order_count,
    count(DISTINCT o.customer_id) AS unique_customers
  FROM valid o JOIN silver_products p ON o.product_id = p.product_id
  GROUP BY p.category
)"""


def _digits(value: str, n: int) -> str:
    return f"lpad(CAST(({value}) % {10**n} AS VARCHAR), {n}, '0')"


_KEY = "c_custkey"
CONTACTS = f"""contacts AS (
  SELECT c_custkey AS contact_id, {_digits(_KEY, 3)} || '-' || {_digits(_KEY, 2)} || '-' || {_digits(_KEY, 4)} AS tax_id,
    '19' || {_digits(_KEY, 2)} || '-' || {_digits("c_custkey % 12 + 1", 2)} || '-' || {_digits("c_custkey % 28 + 1", 2)}
      AS birth_date,
    'P' || {_digits(_KEY, 7)} AS passport_no, 'D' || {_digits(_KEY, 5)} AS license, 'ABC' || {_digits(_KEY, 9)} AS insurance,
    c_custkey || ' Main Street, ' || {_digits(_KEY, 5)} AS address, 'sk-' || md5(CAST(c_custkey AS VARCHAR)) AS api_token,
    'h$2b$10$' || substr(md5(CAST(c_custkey AS VARCHAR)) || md5(c_custkey || 'x'), 1, 53) AS password_hash,
    CASE WHEN c_custkey % 2 = 0 THEN '1111-1111-1111-1111' ELSE '4000-1234-' || {_digits(_KEY, 4)} || '-5678' END
      AS card_number
  FROM customer
)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + "\n"


def union_columns(rows: list[str]) -> str:
    return "\nUNION ALL ".join(rows)


# -- detector ---------------------------------------------------------------------------------------------

FACTS_ALL = f"""{VALID}, weeks_axis AS (
  SELECT CAST(date_trunc('week', (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS DATE) AS last_week,
    CAST(date_trunc('week', (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)) AS DATE) AS last_ship_week,
    (SELECT max(CAST(ts AS DATE)) FROM events) AS last_event_day
), lines AS (
  SELECT v.*, CAST(revenue * tax AS DECIMAL(18,6)) AS cost_value, n_name AS country, c_mktsegment AS segment
  FROM valid v JOIN customer ON v.customer_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
), trade AS (
  SELECT source_table, CAST(date_trunc('week', day) AS DATE) AS week_start_date, country, channel AS device,
    segment AS traffic_source, CAST(count(DISTINCT customer_id) AS DOUBLE) AS fundraisers,
    CAST(sum(revenue) AS DOUBLE) AS gdv, CAST(NULL AS DOUBLE) AS nac2, CAST(count(order_id) AS DOUBLE) AS completes,
    CAST(NULL AS DOUBLE) AS views, CAST(NULL AS DOUBLE) AS clicks, CAST(sum(cost_value) AS DOUBLE) AS cost
  FROM (SELECT 'ORDERS' AS source_table, order_date AS day, * FROM lines
        UNION ALL SELECT 'SHIPMENTS' AS source_table,
          ship_date - CAST((SELECT last_ship_week - last_week FROM weeks_axis) AS INTEGER) AS day, * FROM lines) t
  WHERE day IS NOT NULL
  GROUP BY ALL
), event_facts AS (
  SELECT 'EVENTS' AS source_table,
    last_week - CAST(7 * (last_event_day - CAST(ts AS DATE)) AS INTEGER) AS week_start_date, CAST(NULL AS VARCHAR) AS country,
    CAST(NULL AS VARCHAR) AS device, event_type AS traffic_source,
    CAST(count(DISTINCT user_id) AS DOUBLE) AS fundraisers,
    CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS gdv,
    CAST(count(CASE WHEN event_type = 'signup' THEN 1 END) AS DOUBLE) AS nac2,
    CAST(count(CASE WHEN event_type = 'purchase' THEN 1 END) AS DOUBLE) AS completes,
    CAST(sum(CASE WHEN event_type = 'view' THEN 1 END) AS DOUBLE) AS views,
    CAST(sum(CASE WHEN event_type = 'click' THEN 1 END) AS DOUBLE) AS clicks,
    CAST(sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,2))
      * CASE WHEN CAST(ts AS DATE) = last_event_day THEN 4 ELSE 1 END END) AS DOUBLE) AS cost
  FROM events, weeks_axis WHERE ts IS NOT NULL
  GROUP BY source_table, week_start_date, event_type
), facts AS (SELECT * FROM trade UNION ALL SELECT * FROM event_facts)"""

_METRICS = ("FUNDRAISERS", "GDV", "NAC2", "COMPLETES", "VIEWS", "CLICKS", "COST")
FACTS_LONG = "facts_long AS (" + union_columns(
    [
        f"SELECT source_table, week_start_date, country, device, traffic_source, '{m}' AS metric, "
        f"COALESCE({m.lower()}, 0.0) AS value FROM facts"
        for m in _METRICS
    ]
) + ")"
SERIES = f"""{FACTS_ALL}, {FACTS_LONG}, series AS (
  SELECT source_table, metric, week_start_date, sum(value) AS value FROM facts_long GROUP BY ALL
)"""
CHANNEL_FACTS = f"""{VALID}, channel_facts AS (
  SELECT 'ORDERS' AS source_table, week AS week_start_date, 'ALL' AS country, channel AS device,
    'ALL' AS traffic_source, CAST(sum(revenue) AS DOUBLE) AS gdv, CAST(count(*) AS DOUBLE) AS completes
  FROM valid GROUP BY week, channel
)"""
SEEDED_SERIES = f"""{CHANNEL_FACTS}, plain AS (
  SELECT source_table, week_start_date, sum(gdv) AS gdv, sum(completes) AS completes
  FROM channel_facts GROUP BY ALL
), series AS (
  SELECT source_table, 'GDV' AS metric, week_start_date,
    gdv * CASE week_start_date WHEN DATE '2001-03-05' THEN 4.0e0 WHEN DATE '2001-01-15' THEN 0.4e0 ELSE 1.0e0 END
      AS value
  FROM plain
  UNION ALL SELECT source_table, 'COMPLETES', week_start_date, completes FROM plain
)"""
LAYERS = """base AS (
  SELECT *, count(value) OVER w AS seen, avg(value) OVER w AS mean8, stddev_samp(value) OVER w AS sd8,
    quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.75) OVER w AS q3
  FROM series
  WINDOW w AS (PARTITION BY source_table, metric ORDER BY week_start_date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)
), baseline AS (
  SELECT source_table, metric, week_start_date, value, q1, q3,
    CASE WHEN seen >= 4 THEN seen END AS baseline_count, CASE WHEN seen >= 4 THEN mean8 END AS baseline_avg,
    CASE WHEN seen >= 4 THEN sd8 END AS baseline_std
  FROM base
), scored AS (
  SELECT *, (value - baseline_avg) / nullif(baseline_avg, 0) * 100 AS pct_diff,
    (value - baseline_avg) / nullif(baseline_std, 0) AS z_score,
    COALESCE(value < q1 - 1.5e0 * (q3 - q1) OR value > q3 + 1.5e0 * (q3 - q1), false) AS iqr_outlier
  FROM baseline
), probable AS (
  SELECT *, COALESCE(1.0e0 / (1.0e0 + exp(-baseline_count * z_score * z_score / 4.0e0)), 0.5e0) AS bayes_change_prob,
    sum(COALESCE(z_score - 0.5e0, 0.0e0)) OVER s AS free_high,
    sum(COALESCE(-z_score - 0.5e0, 0.0e0)) OVER s AS free_low
  FROM scored
  WINDOW s AS (PARTITION BY source_table, metric ORDER BY week_start_date ROWS UNBOUNDED PRECEDING)
), drifted AS (
  SELECT *, free_high - least(0.0e0, min(free_high) OVER s) AS cusum_high,
    free_low - least(0.0e0, min(free_low) OVER s) AS cusum_low
  FROM probable
  WINDOW s AS (PARTITION BY source_table, metric ORDER BY week_start_date ROWS UNBOUNDED PRECEDING)
), voted AS (
  SELECT *, CASE WHEN pct_diff <= -10 THEN -1 WHEN pct_diff >= 10 THEN 1 ELSE 0 END AS v1,
    CASE WHEN z_score <= -2 THEN -1 WHEN z_score >= 2 THEN 1 ELSE 0 END AS v2,
    CASE WHEN iqr_outlier THEN CASE WHEN value < baseline_avg THEN -1 ELSE 1 END ELSE 0 END AS v3,
    CASE WHEN cusum_high > 3 THEN 1 WHEN cusum_low > 3 THEN -1 ELSE 0 END AS v4,
    CASE WHEN bayes_change_prob > 0.8 THEN CASE WHEN value < baseline_avg THEN -1 ELSE 1 END ELSE 0 END AS v5
  FROM drifted
), summed AS (
  SELECT *, (v1 + 2.0e0 * v2 + 1.5e0 * v3 + v4 + 1.5e0 * v5) / 7.0e0 AS ensemble_score,
    abs(v1) + abs(v2) + abs(v3) + abs(v4) + abs(v5) AS n_agreeing_layers
  FROM voted
), directed AS (
  SELECT *, n_agreeing_layers / 5.0e0 AS consensus_strength,
    CASE WHEN ensemble_score <= -0.3 THEN 'DROP' WHEN ensemble_score >= 0.3 THEN 'SPIKE' ELSE 'NORMAL' END AS direction
  FROM summed
), summary AS (
  SELECT source_table, metric, week_start_date, value AS actual, baseline_avg, baseline_std, baseline_count, pct_diff,
    z_score, iqr_outlier, cusum_high, cusum_low, bayes_change_prob, ensemble_score, consensus_strength,
    n_agreeing_layers, direction,
    CASE WHEN direction = 'NORMAL' THEN 'LOW'
      WHEN abs(pct_diff) >= 25 OR abs(z_score) >= 3.5 THEN 'CRITICAL'
      WHEN n_agreeing_layers >= 3 AND direction = 'DROP' THEN 'HIGH'
      WHEN n_agreeing_layers >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM directed
)"""
DETECT = f"{SERIES}, {LAYERS}"
DETECT_SEEDED = f"{SEEDED_SERIES}, {LAYERS}"
