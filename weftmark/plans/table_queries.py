"""Registered queries over tables: sources, cleaning, marts, reports, profiles and gates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from weftmark.config import DetectorParams
from weftmark.functions.numbers import price
from weftmark.operators import clean, gate, marts, metrics, profile
from weftmark.plans import inputs, medallion, sql
from weftmark.plans.registry import comparable, query, snap_sql
from weftmark.session import workspace
from weftmark.sources import catalog, files

# -- sources ------------------------------------------------------------------------------------------------

_ORDER_COLUMNS = "order_id, customer_id, product_id, order_date, quantity, unit_price, channel"


@query("ingest_csv", sql.with_(sql.RAW_ORDERS) + f"SELECT {_ORDER_COLUMNS} FROM raw_orders")
def ingest_csv(spark, sf_dir):
    folder = workspace(spark, "csv")
    files.write_csv_table(inputs.raw_orders(spark, sf_dir), folder, "orders")
    return files.read_csv_tables(spark, folder, ["orders"], files.RAW_SCHEMAS)["orders"]


_TYPES = {
    "orders": [
        ("order_id", "bigint"), ("customer_id", "bigint"), ("product_id", "bigint"), ("order_date", "date"),
        ("quantity", "int"), ("unit_price", "string"), ("channel", "string"),
    ],
    "customers": [
        ("customer_id", "bigint"), ("name", "string"), ("email", "string"), ("country", "string"),
        ("signup_date", "date"),
    ],
    "products": [
        ("product_id", "bigint"), ("product_name", "string"), ("category", "string"), ("list_price", "double"),
    ],
}
_RAW = sql.with_(sql.RAW_ORDERS, sql.RAW_CUSTOMERS, sql.RAW_PRODUCTS)


def _profile_rows(extra: str = "") -> str:
    """One SQL row per column of the raw tables: position, type, rows and nulls."""
    return sql.union_columns(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i + 1} AS position, '{kind}' AS data_type, "
            f"count(*) AS row_count, count(*) - count({c}) AS null_count{extra.format(t=t)} FROM raw_{t}"
            for t, columns in _TYPES.items()
            for i, (c, kind) in enumerate(columns)
        ]
    )


def _hash_sql(table: str) -> str:
    signature = ",".join(sorted(f"{c}:{kind}" for c, kind in _TYPES[table]))
    return f"sha256('{signature}')"


_MANIFEST = sql.union_columns(
    [
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i + 1} AS position, '{kind}' AS data_type, "
        f"count(*) AS row_count, count(*) - count({c}) AS null_count, {_hash_sql(t)} AS schema_hash FROM raw_{t}"
        for t, columns in _TYPES.items()
        for i, (c, kind) in enumerate(columns)
    ]
)


@query("bronze_manifest", _RAW + _MANIFEST)
def bronze_manifest(spark, sf_dir):
    return catalog.bronze_manifest(inputs.raw_retail(spark, sf_dir))


@query(
    "schema_drift",
    sql.with_(sql.VALID)
    + """, was AS (SELECT count(*) AS n, count(channel) AS channel, count(quantity) AS quantity, count(unit_price) AS unit_price
        FROM raw_orders), now AS (SELECT count(*) AS n, count(quantity) AS quantity, count(unit_price) AS unit_price,
        count(revenue) AS revenue FROM valid)
      SELECT 'orders' AS table_name, 'channel' AS column_name, 'string' AS old_type, was.n AS old_rows,
        was.n - was.channel AS old_nulls, CAST(NULL AS VARCHAR) AS new_type, CAST(NULL AS BIGINT) AS new_rows,
        CAST(NULL AS BIGINT) AS new_nulls, 'removed' AS change FROM was
      UNION ALL SELECT 'orders', 'quantity', 'int', was.n, was.n - was.quantity, 'bigint', now.n, now.n - now.quantity,
        'retyped' FROM was, now
      UNION ALL SELECT 'orders', 'unit_price', 'string', was.n, was.n - was.unit_price, 'decimal(18,4)', now.n,
        now.n - now.unit_price, 'retyped' FROM was, now
      UNION ALL SELECT 'orders', 'revenue', NULL, NULL, NULL, 'decimal(18,4)', now.n, now.n - now.revenue, 'added' FROM now""",
)
def schema_drift(spark, sf_dir):
    old = inputs.raw_orders(spark, sf_dir)
    new = clean.orders_clean(old).drop("channel").withColumn("quantity", F.col("quantity").cast("bigint"))
    return catalog.schema_drift(
        catalog.bronze_manifest({"orders": old}), catalog.bronze_manifest({"orders": new})
    )


_TABLE_COUNTS = sql.union_columns([f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in inputs.TABLES])


@query(
    "catalog_columns",
    f"""SELECT DISTINCT table_name, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
        WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
        WHEN 'FLOAT[]' THEN 'array<float>' ELSE data_type END AS data_type,
      CAST(ordinal_position AS INT) AS position, n AS row_count
      FROM information_schema.columns JOIN ({_TABLE_COUNTS}) ON table_name = t""",
)
def catalog_columns(spark, sf_dir):
    return catalog.catalog_columns(inputs.all_tables(spark, sf_dir))


# keywords for the roles of the test tables
TEST_KEYWORDS = {
    **gate.ROLE_KEYWORDS,
    "gdv": ("totalprice", "extendedprice", "unit_price", "value", "acctbal"),
    "cost": ("tax", "unit_price"),
    "fundraiser": ("custkey", "customer_id", "user_id"),
}


@query(
    "role_profile",
    f"""SELECT table_name, role, column_name, n AS row_count FROM (VALUES
      ('lineitem', 'date', 'l_shipdate'), ('lineitem', 'gdv', 'l_extendedprice'), ('lineitem', 'cost', 'l_tax'),
      ('orders', 'date', 'o_orderdate'), ('orders', 'gdv', 'o_totalprice'), ('orders', 'fundraiser', 'o_custkey'),
      ('events', 'date', 'ts'), ('events', 'gdv', 'value'), ('events', 'fundraiser', 'user_id'),
      ('customer', 'gdv', 'c_acctbal'), ('customer', 'fundraiser', 'c_custkey'), ('supplier', 'gdv', 's_acctbal'),
      ('documents', 'source', 'source')) AS t(table_name, role, column_name)
      JOIN ({_TABLE_COUNTS}) AS counted ON t.table_name = counted.t""",
)
def role_profile(spark, sf_dir):
    return gate.role_profile(catalog.catalog_columns(inputs.all_tables(spark, sf_dir)), TEST_KEYWORDS)


@query(
    "adhoc_sql",
    sql.with_(sql.RAW_ORDERS)
    + "SELECT product_id, count(*) AS n FROM raw_orders GROUP BY product_id ORDER BY n DESC, product_id",
)
def adhoc_sql(spark, sf_dir):
    text = "SELECT product_id, count(*) AS n FROM {orders} GROUP BY product_id ORDER BY n DESC, product_id"
    return files.adhoc_sql(spark, text, inputs.raw_retail(spark, sf_dir))


@query(
    "save_with_provenance",
    sql.with_(sql.GOLD) + "SELECT *, (SELECT count(*) FROM weekly_sales) AS noted_rows FROM weekly_sales",
)
def save_with_provenance(spark, sf_dir):
    table = "weftmark_weekly_sales"
    silver = clean.silver_orders(inputs.raw_orders(spark, sf_dir))
    files.save_with_provenance(marts.gold_weekly_sales(silver), table, "weekly sales")
    note = files.read_provenance(spark, table)
    return spark.table(table).withColumn("noted_rows", F.lit(note["row_count"]).cast("bigint"))


_EVENT_LOG = """SELECT event_id, user_id AS run_id, ts, event_type AS agent,
    CASE event_type WHEN 'signup' THEN 'profile' WHEN 'view' THEN 'etl' WHEN 'click' THEN 'sql'
      WHEN 'error' THEN 'anomaly' WHEN 'purchase' THEN 'report' ELSE '' END AS step,
    CASE event_type WHEN 'error' THEN 'job_failed' WHEN 'purchase' THEN 'job_finished' ELSE 'tool_call' END AS type,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
    TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_in,
    2 * TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_out,
    CAST(55 * TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS DOUBLE) / 1e6 AS cost_usd,
    CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) / 100e0 AS duration_s
  FROM events"""


@query("event_log_read", _EVENT_LOG)
def event_log_read(spark, sf_dir):
    path = workspace(spark, "event-log")
    files.write_event_log(inputs.run_events(spark, sf_dir), path)
    return comparable(files.read_event_log(spark, path)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "event_log_write",
    f"""SELECT agent, count(*) AS lines, sum(tokens_in)::BIGINT AS tokens_in,
      strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS newest FROM ({_EVENT_LOG}) GROUP BY agent""",
)
def event_log_write(spark, sf_dir):
    """The written lines as plain text: one JSON object each."""
    path = workspace(spark, "event-log")
    files.write_event_log(inputs.run_events(spark, sf_dir), path)
    lines = spark.read.text(path).select(F.json_tuple("value", "agent", "tokens_in", "ts").alias("agent", "tokens", "ts"))
    return lines.groupBy("agent").agg(
        F.count("*").alias("lines"), F.sum(F.col("tokens").cast("bigint")).alias("tokens_in"), F.max("ts").alias("newest")
    )


@query(
    "sample_rows",
    sql.with_(sql.RAW_ORDERS)
    + f"""SELECT {", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _ORDER_COLUMNS.split(", "))} FROM (
      SELECT * FROM raw_orders ORDER BY {_ORDER_COLUMNS} LIMIT 5)""",
)
def sample_rows(spark, sf_dir):
    orders = inputs.raw_orders(spark, sf_dir)
    return files.sample_rows(orders, orders.columns, 5)


# -- cleaning -----------------------------------------------------------------------------------------------


@query(
    "silver_orders",
    sql.with_(sql.SILVER_ORDERS)
    + """SELECT order_id, customer_id, product_id, order_date, quantity, CAST(unit_price AS DOUBLE) AS unit_price,
      channel FROM silver_orders""",
)
def silver_orders(spark, sf_dir):
    return comparable(clean.silver_orders(inputs.raw_orders(spark, sf_dir)))


@query(
    "orders_clean",
    sql.with_(sql.VALID)
    + """SELECT order_id, customer_id, product_id, order_date, quantity, CAST(unit_price AS DOUBLE) AS unit_price,
      channel, CAST(revenue AS DOUBLE) AS revenue FROM valid""",
)
def orders_clean(spark, sf_dir):
    return comparable(clean.orders_clean(inputs.raw_orders(spark, sf_dir)))


@query("silver_customers", sql.with_(sql.SILVER_CUSTOMERS) + "SELECT * FROM silver_customers")
def silver_customers(spark, sf_dir):
    return clean.silver_customers(inputs.raw_customers(spark, sf_dir))


@query("customers_clean", sql.with_(sql.RAW_CUSTOMERS) + "SELECT DISTINCT * FROM raw_customers")
def customers_clean(spark, sf_dir):
    return clean.customers_clean(inputs.raw_customers(spark, sf_dir))


@query("silver_products", sql.with_(sql.SILVER_PRODUCTS) + "SELECT * FROM silver_products")
def silver_products(spark, sf_dir):
    return clean.silver_products(inputs.raw_products(spark, sf_dir), inputs.PART_CATEGORIES)


@query(
    "silver_quality_report",
    sql.with_(sql.SILVER_ORDERS, sql.SILVER_CUSTOMERS, sql.RAW_PRODUCTS)
    + """SELECT (SELECT count(*) FROM silver_orders) AS total_orders,
      (SELECT count(*) FROM silver_orders WHERE quantity IS NULL) AS bad_quantity,
      (SELECT count(*) FROM silver_orders WHERE unit_price IS NULL) AS bad_price,
      (SELECT count(*) FROM silver_orders WHERE order_date IS NULL) AS null_dates,
      (SELECT count(*) FROM raw_customers) AS total_customers,
      (SELECT count(*) FROM raw_customers) - (SELECT count(*) FROM silver_customers) AS duplicate_customers,
      (SELECT count(*) FROM raw_products) AS total_products,
      (SELECT count(*) FROM raw_products WHERE category NOT IN ('STANDARD', 'PROMO', 'LARGE', 'ECONOMY'))
        AS bad_categories""",
)
def silver_quality_report(spark, sf_dir):
    raw = inputs.raw_retail(spark, sf_dir)
    return clean.silver_quality_report(raw["orders"], raw["customers"], raw["products"], inputs.PART_CATEGORIES)


_DATE_TEXT = """CASE WHEN l_linenumber = 1 THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m-%d') END"""


@query(
    "safe_timestamp",
    f"""SELECT l_orderkey, l_linenumber, TRY_CAST({_DATE_TEXT} AS TIMESTAMP) AS parsed,
      CAST(l_shipdate AS TIMESTAMP) AS kept FROM lineitem""",
)
def safe_timestamp(spark, sf_dir):
    text = F.when(F.col("l_linenumber") == 1, "unknown").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    lines = inputs.read(spark, sf_dir, "lineitem").withColumn("shipped_text", text)
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        clean.safe_timestamp(lines, "shipped_text").cast("timestamp_ntz").alias("parsed"),
        clean.safe_timestamp(lines, "l_shipdate").cast("timestamp_ntz").alias("kept"),
    )


@query(
    "safe_number_sum",
    sql.with_(sql.RAW_ORDERS)
    + f"""SELECT channel, {snap_sql("sum(TRY_CAST(unit_price AS DOUBLE))", 2)} AS price_sum,
      sum(quantity)::BIGINT AS quantity_sum FROM raw_orders GROUP BY channel""",
)
def safe_number_sum(spark, sf_dir):
    orders = inputs.raw_orders(spark, sf_dir)
    sums = orders.groupBy("channel").agg(
        clean.safe_number_sum(orders, "unit_price").alias("price_sum"),
        clean.safe_number_sum(orders, "quantity").alias("quantity_sum"),
    )
    return comparable(sums, price_sum=2)


# -- marts and questions --------------------------------------------------------------------------------------

_GOLD = sql.with_(sql.GOLD)


def _layers(spark, sf_dir):
    return medallion.medallion(inputs.raw_retail(spark, sf_dir), inputs.PART_CATEGORIES)


@query(
    "medallion_run",
    _GOLD
    + """SELECT 'silver_orders' AS layer, count(*) AS row_count, CAST(NULL AS DOUBLE) AS revenue FROM silver_orders
      UNION ALL SELECT 'silver_customers', count(*), NULL FROM silver_customers
      UNION ALL SELECT 'silver_products', count(*), NULL FROM silver_products
      UNION ALL SELECT 'gold_weekly_sales', count(*), CAST(sum(CAST(revenue AS DECIMAL(28,2))) AS DOUBLE) FROM weekly_sales
      UNION ALL SELECT 'gold_customer_metrics', count(*), NULL FROM customer_metrics
      UNION ALL SELECT 'gold_category_performance', count(*), CAST(sum(CAST(revenue AS DECIMAL(28,2))) AS DOUBLE)
        FROM category_performance""",
)
def medallion_run(spark, sf_dir):
    """Save silver, build gold from the saved tables, save it, and count what is stored."""
    saved = medallion.run_medallion(inputs.raw_retail(spark, sf_dir), "default", inputs.PART_CATEGORIES, prefix="weftmark_")

    def counted(layer):
        df = saved[layer]
        money = F.sum(F.col("revenue").cast("decimal(28,2)")).cast("double") if "revenue" in df.columns else F.lit(None).cast("double")
        return df.agg(F.count("*").alias("row_count"), money.alias("revenue")).select(F.lit(layer).alias("layer"), "row_count", "revenue")

    return profile.union_all([counted(layer) for layer in saved])


for _mart, _cte in (
    ("gold_weekly_sales", "weekly_sales"),
    ("gold_customer_metrics", "customer_metrics"),
    ("gold_category_performance", "category_performance"),
):
    query(_mart, _GOLD + f"SELECT * FROM {_cte}")(lambda spark, sf_dir, name=_mart: _layers(spark, sf_dir)[name])


@query(
    "mart_totals",
    _GOLD
    + """SELECT 'gold_weekly_sales' AS mart, count(*) AS row_count,
        CAST(sum(CAST(revenue AS DECIMAL(28,2))) AS DOUBLE) AS total_revenue,
        floor(CAST(sum(CAST(revenue AS DECIMAL(28,2))) AS DOUBLE) / count(revenue) * 100 + 0.5) / 100
          AS avg_weekly_revenue, CAST(NULL AS DOUBLE) AS avg_lifetime_value FROM weekly_sales
      UNION ALL SELECT 'gold_customer_metrics', count(*), NULL, NULL,
        floor(CAST(sum(CAST(lifetime_value AS DECIMAL(28,2))) AS DOUBLE) / count(lifetime_value) * 100 + 0.5) / 100
        FROM customer_metrics
      UNION ALL SELECT 'gold_category_performance', count(*), CAST(sum(CAST(revenue AS DECIMAL(28,2))) AS DOUBLE),
        NULL, NULL FROM category_performance""",
)
def mart_totals(spark, sf_dir):
    """Totals of the stored marts."""
    made = medallion.run_medallion(
        inputs.raw_retail(spark, sf_dir), "default", inputs.PART_CATEGORIES, prefix="weftmark_totals_"
    )
    return marts.mart_totals(
        made["gold_weekly_sales"], made["gold_customer_metrics"], made["gold_category_performance"]
    )


_REVENUE = "CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue"
_VALID = sql.with_(sql.VALID)


@query(
    "top_products",
    sql.with_(sql.VALID, sql.RAW_PRODUCTS)
    + f"""SELECT product_name, category, {_REVENUE} FROM valid JOIN raw_products USING (product_id)
      GROUP BY product_name, category ORDER BY revenue DESC, product_name, category LIMIT 5""",
)
def top_products(spark, sf_dir):
    return marts.top_products(inputs.raw_orders(spark, sf_dir), inputs.raw_products(spark, sf_dir))


@query(
    "category_revenue",
    sql.with_(sql.VALID, sql.RAW_PRODUCTS)
    + f"SELECT category, {_REVENUE} FROM valid JOIN raw_products USING (product_id) GROUP BY category",
)
def category_revenue(spark, sf_dir):
    return marts.category_revenue(inputs.raw_orders(spark, sf_dir), inputs.raw_products(spark, sf_dir))


@query(
    "monthly_revenue",
    _VALID + f"""SELECT strftime(order_date, '%Y-%m') AS month, {_REVENUE}, count(*) AS order_count
      FROM valid GROUP BY 1""",
)
def monthly_revenue(spark, sf_dir):
    return marts.monthly_revenue(inputs.raw_orders(spark, sf_dir))


@query("weekly_revenue_trend", _VALID + f"SELECT week, {_REVENUE}, count(*) AS order_count FROM valid GROUP BY week")
def weekly_revenue_trend(spark, sf_dir):
    return marts.weekly_revenue_trend(inputs.raw_orders(spark, sf_dir))


_REPEAT = "floor(count(*) FILTER (WHERE n > 1) * 100.0e0 / count(*) * 10 + 0.5) / 10"


@query(
    "repeat_customer_rate",
    sql.with_(sql.RAW_ORDERS)
    + f"""SELECT {_REPEAT} AS repeat_customer_pct, count(*) AS total_customers,
      count(*) FILTER (WHERE n > 1) AS repeat_customers
      FROM (SELECT customer_id, count(*) AS n FROM raw_orders GROUP BY customer_id)""",
)
def repeat_customer_rate(spark, sf_dir):
    return marts.repeat_customer_rate(inputs.raw_orders(spark, sf_dir))


@query("revenue_by_channel", _VALID + f"SELECT channel, {_REVENUE}, count(*) AS orders FROM valid GROUP BY channel")
def revenue_by_channel(spark, sf_dir):
    return marts.revenue_by_channel(inputs.raw_orders(spark, sf_dir))


@query(
    "revenue_by_country",
    sql.with_(sql.VALID, sql.SILVER_CUSTOMERS)
    + f"""SELECT country, {_REVENUE}, count(*) AS orders FROM valid JOIN silver_customers USING (customer_id)
      GROUP BY country""",
)
def revenue_by_country(spark, sf_dir):
    customers = clean.silver_customers(inputs.raw_customers(spark, sf_dir))
    return marts.revenue_by_country(inputs.raw_orders(spark, sf_dir), customers)


@query(
    "entity_counts",
    _RAW + """SELECT (SELECT count(DISTINCT customer_id) FROM raw_customers) AS total_customers,
      (SELECT count(*) FROM raw_products) AS total_products, (SELECT count(*) FROM raw_orders) AS total_orders""",
)
def entity_counts(spark, sf_dir):
    raw = inputs.raw_retail(spark, sf_dir)
    return marts.entity_counts(raw["orders"], raw["customers"], raw["products"])


@query(
    "avg_order_value",
    _VALID + """SELECT floor(CAST(sum(t) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS avg_order_value
      FROM (SELECT order_id, sum(revenue) AS t FROM valid GROUP BY order_id)""",
)
def avg_order_value(spark, sf_dir):
    return marts.avg_order_value(inputs.raw_orders(spark, sf_dir))


@query(
    "kpi_report",
    _VALID + """SELECT count(DISTINCT customer_id) AS active_customers, count(*) AS total_orders,
      floor(CAST(sum(revenue) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS avg_order_value,
      CAST(round(sum(revenue), 2) AS DOUBLE) AS total_revenue FROM valid""",
)
def kpi_report(spark, sf_dir):
    return marts.kpi_report(inputs.raw_orders(spark, sf_dir))


@query(
    "executive_facts",
    _VALID + """, weekly AS (SELECT week, round(sum(revenue), 2) AS r FROM valid GROUP BY week),
      facts AS (SELECT (SELECT count(*) FROM weekly) AS periods,
        (SELECT CAST(round(sum(revenue), 2) AS DOUBLE) FROM valid) AS total_revenue,
        (SELECT floor(CAST(sum(CAST(r AS DECIMAL(28,2))) AS DOUBLE) / count(*) * 100 + 0.5) / 100 FROM weekly)
          AS avg_weekly_revenue,
        (SELECT CAST(r AS DOUBLE) FROM weekly ORDER BY week DESC LIMIT 1) AS latest_revenue,
        (SELECT count(*) FROM silver_orders) AS total_orders,
        (SELECT count(*) FROM silver_orders WHERE quantity IS NULL) AS bad_quantity,
        (SELECT count(*) FROM silver_orders WHERE unit_price IS NULL) AS bad_price,
        (SELECT count(DISTINCT customer_id) FROM silver_orders) AS active_customers,
        (SELECT count(*) FROM (SELECT customer_id FROM silver_orders GROUP BY 1 HAVING count(*) > 1))
          AS repeat_customers)
      SELECT *, CASE WHEN latest_revenue > avg_weekly_revenue THEN 'up'
          WHEN latest_revenue < avg_weekly_revenue THEN 'down' ELSE 'flat' END AS trend,
        floor(bad_quantity * 100.0e0 / total_orders * 10 + 0.5) / 10 AS bad_quantity_pct,
        floor(bad_price * 100.0e0 / total_orders * 10 + 0.5) / 10 AS bad_price_pct,
        floor(repeat_customers * 100.0e0 / active_customers * 10 + 0.5) / 10 AS repeat_rate FROM facts""",
)
def executive_facts(spark, sf_dir):
    return marts.executive_facts(inputs.raw_orders(spark, sf_dir))


@query(
    "breakeven_by_group",
    _VALID + f""", monthly AS (
        SELECT channel, strftime(order_date, '%Y-%m') AS month, CAST(sum(revenue) AS DOUBLE) AS income
        FROM valid GROUP BY 1, 2),
      numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY channel ORDER BY month) AS INT) AS month_no FROM monthly),
      netted AS (SELECT *, income * least(1.0e0, month_no / 6.0e0) - {inputs.FIXED_COST} AS net FROM numbered),
      running AS (SELECT *, sum(net) OVER (PARTITION BY channel ORDER BY month) AS cumulative FROM netted)
      SELECT channel, month, month_no, {snap_sql("income", 2)} AS income, {snap_sql("net", 2)} AS net,
        {snap_sql("cumulative", 2)} AS cumulative,
        min(CASE WHEN cumulative > 0 THEN month_no END) OVER (PARTITION BY channel) AS payback_month FROM running""",
)
def breakeven_by_group(spark, sf_dir):
    cost = inputs.FIXED_COST
    return comparable(marts.breakeven_by_group(inputs.raw_orders(spark, sf_dir), cost), 2)


# -- metrics --------------------------------------------------------------------------------------------------


def _registry(spark, sf_dir):
    return metrics.MetricRegistry(medallion.metric_tables(_layers(spark, sf_dir)))


_METRIC_SQL = {
    "total_revenue": "SELECT CAST(round(sum(revenue), 2) AS DOUBLE) AS total_revenue FROM valid",
    "avg_order_value": "SELECT floor(CAST(sum(revenue) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS avg_order_value FROM valid",
    "repeat_customer_rate": """SELECT floor(1000.0e0 * count(*) FILTER (WHERE n > 1) / count(*) + 0.5) / 10
      AS repeat_customer_rate FROM (SELECT customer_id, count(*) AS n FROM silver_orders GROUP BY 1)""",
    "weekly_active_customers": "SELECT week, unique_customers AS weekly_active_customers FROM weekly_sales",
    "category_revenue_share": "SELECT category, revenue AS category_revenue FROM category_performance",
    "customer_lifetime_value_avg": """SELECT floor(CAST(sum(CAST(lifetime_value AS DECIMAL(28,2))) AS DOUBLE)
      / count(lifetime_value) * 100 + 0.5) / 100 AS avg_lifetime_value FROM customer_metrics""",
}
for _name, _text in _METRIC_SQL.items():
    query(f"metric_{_name}", _GOLD + _text)(
        lambda spark, sf_dir, name=_name: _registry(spark, sf_dir).resolve(name)
    )


_METRIC_FILE = """
metrics:
  - name: mean_quantity
    description: Mean quantity of valid lines
    source_table: valid_orders
    measure: avg(quantity)
    dimensions: [channel, customer_id]
"""


@query(
    "metric_registry",
    _GOLD + """SELECT 'by channel' AS cut, channel AS label, CAST(round(sum(revenue), 2) AS DOUBLE) AS value
        FROM valid GROUP BY channel
      UNION ALL SELECT 'by country', country, CAST(round(sum(revenue), 2) AS DOUBLE)
        FROM valid JOIN silver_customers USING (customer_id) GROUP BY country
      UNION ALL SELECT 'registered', 'orders', CAST(count(*) AS DOUBLE) FROM silver_orders
      UNION ALL SELECT 'from file', channel, round(CAST(sum(quantity) AS DOUBLE) / count(quantity), 6) FROM valid
        GROUP BY channel""",
)
def metric_registry(spark, sf_dir):
    registry = _registry(spark, sf_dir)
    registry.register("all_orders", "SELECT CAST(count(*) AS DOUBLE) AS value FROM {silver_orders}")
    registry.from_yaml(_METRIC_FILE)

    def cut(dimension):
        by = registry.resolve("total_revenue", [dimension])
        return by.select(
            F.lit(f"by {dimension}").alias("cut"), F.col(dimension).alias("label"), F.col("total_revenue").alias("value")
        )

    own = registry.resolve("all_orders").select(F.lit("registered").alias("cut"), F.lit("orders").alias("label"), "value")
    grouped = registry.resolve("mean_quantity", ["channel"]).select(
        F.lit("from file").alias("cut"), F.col("channel").alias("label"), F.round("mean_quantity", 6).alias("value")
    )
    return profile.union_all([cut("channel"), cut("country"), own, grouped])


def _set_sql(metric: str, value: str, country: bool) -> str:
    """All sets of channel and, if wanted, country."""
    sets = "(), (channel), (country), (channel, country)" if country else "(), (channel)"
    name = "concat_ws(',', CASE WHEN grouping(channel) = 0 THEN 'channel' END"
    name += ", CASE WHEN grouping(country) = 0 THEN 'country' END)" if country else ")"
    return f"""SELECT '{metric}' AS metric, {name} AS dimension_set, channel, {"country" if country else "NULL AS country"}, {value} AS value
      FROM homed GROUP BY GROUPING SETS ({sets})"""


@query(
    "metric_registry_sets",
    _GOLD.rstrip() + """, homed AS (
        SELECT v.*, country FROM valid v LEFT JOIN (SELECT customer_id, min(country) AS country FROM silver_customers GROUP BY 1) USING (customer_id))
      """ + sql.union_columns([
        _set_sql("total_revenue", "CAST(round(sum(revenue), 2) AS DOUBLE)", True),
        _set_sql("avg_order_value", "floor(CAST(sum(revenue) AS DOUBLE) / count(revenue) * 100 + 0.5) / 100", False),
        _set_sql("active_customers", "CAST(count(DISTINCT customer_id) AS DOUBLE)", True),
    ]),
)
def metric_registry_sets(spark, sf_dir):
    """All sets of dimensions of three metrics, one of which counts distinct customers."""
    registry = _registry(spark, sf_dir)
    registry.register(
        "active_customers", source="valid_orders", wide_source="valid_orders_by_country", dimensions=("channel", "country"),
        parts=[("customers", "distinct", "customer_id")], formula="customers",
    )

    def sets(name):
        found = registry.resolve_sets(name)
        country = F.col("country") if "country" in found.columns else F.lit(None).cast("string")
        return found.select(F.lit(name).alias("metric"), "dimension_set", "channel", country.alias("country"), F.col(name).alias("value"))

    return profile.union_all([sets(n) for n in ("total_revenue", "avg_order_value", "active_customers")])


# -- profiling --------------------------------------------------------------------------------------------------


@query("profile_table", _RAW + _profile_rows())
def profile_table(spark, sf_dir):
    return profile.profile_tables(inputs.raw_retail(spark, sf_dir)).select(
        "table_name", "column_name", "position", "data_type", "row_count", "null_count"
    )


@query(
    "null_findings",
    _RAW + f"""SELECT table_name, column_name, 'null_count' AS "check", null_count AS value,
      CASE WHEN null_count > row_count * 0.1e0 THEN 'high' ELSE 'low' END AS severity
      FROM ({_profile_rows()}) WHERE null_count > 0""",
)
def null_findings(spark, sf_dir):
    return profile.null_findings(inputs.raw_retail(spark, sf_dir))


@query(
    "duplicate_rows",
    _RAW + "SELECT * FROM (" + sql.union_columns(
        [
            f"""SELECT '{t}' AS table_name, 'duplicate_rows' AS "check",
            (SELECT count(*) FROM raw_{t}) - (SELECT count(*) FROM (SELECT DISTINCT
              {", ".join(c for c, _ in columns)} FROM raw_{t})) AS value, 'medium' AS severity"""
            for t, columns in _TYPES.items()
        ]
    ) + ") WHERE value > 0",
)
def duplicate_rows(spark, sf_dir):
    return profile.duplicate_rows(inputs.raw_retail(spark, sf_dir))


@query(
    "iqr_outliers",
    sql.with_(sql.SILVER_ORDERS) + f""", prices AS (
        SELECT CAST(unit_price AS DOUBLE) AS p FROM silver_orders WHERE unit_price IS NOT NULL),
      fences AS (SELECT quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.75) AS q3 FROM prices),
      bounds AS (SELECT q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM fences)
      SELECT {snap_sql("max(lo)", 6)} AS lower_bound, {snap_sql("max(hi)", 6)} AS upper_bound,
        count(*) FILTER (WHERE p < lo OR p > hi) AS outliers, count(*) AS total
      FROM prices, bounds HAVING count(*) > 3""",
)
def iqr_outliers(spark, sf_dir):
    return comparable(profile.iqr_outliers(inputs.raw_orders(spark, sf_dir)), 6)


_PAIRS = f"""{sql.VALID}, pairs AS (
  SELECT week, 'GDV' AS metric, CAST(sum(revenue) AS DOUBLE) AS actual FROM valid GROUP BY week
  UNION ALL SELECT week, 'Order Count', CAST(count(*) AS DOUBLE) FROM valid GROUP BY week
), pct AS (
  SELECT metric, 'pct_change' AS detector, week, abs((actual - prev) / greatest(prev, 1.0e0)) * 100 AS size, actual,
    prev AS reference, 100.0e0 AS high, 50.0e0 AS low, n >= 4 AS enough
  FROM (SELECT *, lag(actual) OVER (PARTITION BY metric ORDER BY week) AS prev,
    count(*) OVER (PARTITION BY metric) AS n FROM pairs)
), z AS (
  SELECT metric, 'z_score' AS detector, week, abs((actual - m) / nullif(s, 0)) AS size, actual, m AS reference,
    3.0e0 AS high, 2.0e0 AS low, n > 4 AS enough
  FROM (SELECT *, avg(actual) OVER w AS m, stddev_pop(actual) OVER w AS s, count(*) OVER w AS n FROM pairs
    WINDOW w AS (PARTITION BY metric))
)"""


def _finding_columns(table: str) -> str:
    return f"""SELECT metric, detector, week, CASE WHEN size > high THEN 'high' ELSE 'medium' END AS severity,
      {snap_sql("size", 5)} AS size, {snap_sql("actual", 2)} AS actual, {snap_sql("reference", 2)} AS reference
      FROM {table} WHERE enough AND size > low"""


def _findings(df):
    return comparable(df, 2, size=5)


@query(
    "iqr_outliers_sketch",
    sql.with_(sql.SILVER_ORDERS) + "SELECT count(unit_price) AS total, true AS ranks_within FROM silver_orders",
)
def iqr_outliers_sketch(spark, sf_dir):
    """The sketch's quartiles and outlier count, held against their exact ranks in the data."""
    orders, error = inputs.raw_orders(spark, sf_dir), profile.SKETCH_ERROR
    prices = orders.select(price(F.col("unit_price")).cast("double").alias("p")).where("p IS NOT NULL")
    rows = prices.withColumn("s", profile.iqr_outliers_sketch(orders).select(F.struct("*")).scalar())

    def share(condition):
        return F.count_if(condition) / F.count("*")

    near = [
        (share(F.col("p") < F.col(f"s.{c}")) <= rank + error) & (share(F.col("p") <= F.col(f"s.{c}")) >= rank - error)
        for c, rank in (("q1", 0.25), ("q3", 0.75))
    ]
    outside = share((F.col("p") < F.col("s.lower_bound")) | (F.col("p") > F.col("s.upper_bound")))
    counted = F.abs(outside - F.max("s.outliers") / F.count("*")) <= 2 * error
    return rows.agg(F.max("s.total").alias("total"), (near[0] & near[1] & counted).alias("ranks_within"))


@query("pct_change_anomalies", sql.with_(_PAIRS) + _finding_columns("pct"))
def pct_change_anomalies(spark, sf_dir):
    return _findings(profile.pct_change_anomalies(inputs.raw_orders(spark, sf_dir)))


@query("zscore_anomalies", sql.with_(_PAIRS) + _finding_columns("z"))
def zscore_anomalies(spark, sf_dir):
    return _findings(profile.zscore_anomalies(inputs.raw_orders(spark, sf_dir)))


@query(
    "top_findings",
    sql.with_(_PAIRS)
    + f"""SELECT * FROM ({_finding_columns("pct")} UNION ALL {_finding_columns("z")})
      ORDER BY floor(size * 10000 + 0.5) DESC, metric, detector, week LIMIT 5""",
)
def top_findings(spark, sf_dir):
    return _findings(profile.top_findings(inputs.raw_orders(spark, sf_dir)))


_DESCRIBED = "CASE " + " ".join(
    f"WHEN table_name = '{t}' AND column_name = '{c}' THEN '{text}'" for (t, c), text in profile.DESCRIPTIONS.items()
) + " ELSE '—' END"


@query(
    "data_dictionary",
    sql.with_(sql.RAW_ORDERS, sql.RAW_CUSTOMERS, sql.RAW_PRODUCTS, f"described AS ({_profile_rows()})")
    + f"""SELECT table_name, column_name, data_type, null_count, {_DESCRIBED} AS description FROM described
      UNION ALL SELECT 'nation', 'n_name', 'string', count(*) - count(n_name), '—' FROM nation""",
)
def data_dictionary(spark, sf_dir):
    tables = inputs.raw_retail(spark, sf_dir)
    tables["nation"] = inputs.read(spark, sf_dir, "nation").select("n_name")
    return profile.data_dictionary(tables)


@query(
    "schema_counts",
    _RAW + sql.union_columns(
        [
            f"SELECT '{t}' AS table_name, count(*) AS row_count, '{', '.join(f'{c} {k}' for c, k in columns)}' AS columns "
            f"FROM raw_{t}"
            for t, columns in _TYPES.items()
        ]
    ),
)
def schema_counts(spark, sf_dir):
    return profile.schema_counts(inputs.raw_retail(spark, sf_dir))


# -- gates ----------------------------------------------------------------------------------------------------

_ROWS_ISSUE = """SELECT 'row_count' AS "check", t AS table_name,
  'Table ' || t || ' has only ' || n || ' rows (min: 10)' AS issue, false AS fatal
  FROM (SELECT 'region' AS t, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation
    UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events) WHERE n < 10
  UNION ALL SELECT 'row_count', 'absent', 'Table absent does not exist or is not accessible — skipping', false"""
_NULL_ISSUE = """SELECT 'null_fraction' AS "check", 'retail' AS table_name,
  'Table retail.unit_price is ' || CAST(floor(share * 100 + 0.5) AS BIGINT) || '% null (max: 0%)' AS issue,
  false AS fatal
  FROM (SELECT (count(*) - count(unit_price)) / CAST(count(*) AS DOUBLE) AS share FROM silver_orders)
  WHERE share > 0.0001e0"""
_DATE_ISSUE = """SELECT 'date_coverage' AS "check", 'events' AS table_name,
  'Table events.ts spans only ' || CAST(floor(days / 7.0e0 + 0.5) AS BIGINT) || ' weeks (expected ~26)' AS issue,
  false AS fatal
  FROM (SELECT date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS days FROM events) WHERE days / 7.0e0 < 13"""
_TYPE_TEXT = "Table retail_raw.unit_price ({role}) has type STRING — expected numeric; will use TRY_TO_NUMBER"
_TYPE_ISSUE = "\nUNION ALL ".join(
    f"""SELECT 'metric_type' AS "check", 'retail_raw' AS table_name, '{_TYPE_TEXT.format(role=role)}' AS issue,
    false AS fatal, count(*) FILTER (WHERE TRY_CAST(unit_price AS DOUBLE) IS NULL) AS unparsable FROM raw_orders"""
    for role in ("gdv", "cost")
)


def _gate_tables(spark, sf_dir):
    plain = {t: inputs.read(spark, sf_dir, t) for t in ("region", "nation", "orders", "events")}
    orders = inputs.raw_orders(spark, sf_dir)
    return {**plain, "absent": None}, {"retail": clean.silver_orders(orders), "events": plain["events"]}, {
        "retail_raw": orders,
        "orders": plain["orders"],
    }


_STRICT = replace(DetectorParams(), max_null_fraction=0.0001)


@query("gate_row_counts", _ROWS_ISSUE)
def gate_row_counts(spark, sf_dir):
    return gate.gate_row_counts(_gate_tables(spark, sf_dir)[0])


@query("gate_null_fraction", sql.with_(sql.SILVER_ORDERS) + _NULL_ISSUE)
def gate_null_fraction(spark, sf_dir):
    return gate.gate_null_fraction(_gate_tables(spark, sf_dir)[1], _STRICT, TEST_KEYWORDS)


@query("gate_date_coverage", _DATE_ISSUE)
def gate_date_coverage(spark, sf_dir):
    return gate.gate_date_coverage(_gate_tables(spark, sf_dir)[1], keywords=TEST_KEYWORDS)


@query("gate_metric_types", sql.with_(sql.RAW_ORDERS) + _TYPE_ISSUE)
def gate_metric_types(spark, sf_dir):
    return gate.gate_metric_types(_gate_tables(spark, sf_dir)[2], TEST_KEYWORDS)


@query(
    "quality_gate",
    sql.with_(sql.SILVER_ORDERS)
    + f"""SELECT *, true AS passed FROM ({_ROWS_ISSUE} UNION ALL {_NULL_ISSUE} UNION ALL {_DATE_ISSUE}
      UNION ALL SELECT "check", table_name, issue, fatal FROM ({_TYPE_ISSUE}))""",
)
def quality_gate(spark, sf_dir):
    small, dated, typed = _gate_tables(spark, sf_dir)
    return gate.quality_gate({**small, **dated, **typed}, _STRICT, TEST_KEYWORDS)
