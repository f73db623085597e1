"""The test tables as retail, event and vector inputs (mapping in FIXTURES.md)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.operators.clean import silver_customers, silver_orders, silver_products
from weftmark.operators.facts import (
    Roles,
    deal_by_fundraiser,
    deal_where_many,
    seed_periods,
    weekly_channel_facts,
    weekly_facts,
    weekly_facts_by_dates,
    weekly_facts_union,
    weekly_series,
)
from weftmark.operators.runlog import token_cost

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
PART_CATEGORIES = ("STANDARD", "PROMO", "LARGE", "ECONOMY")
SEEDED_WEEKS = {"2001-03-05": 4.0, "2001-01-15": 0.4}
FIXED_COST = 4_000_000.0
# rows of parts that Spark may broadcast, some 130 MB; a file's bytes, by which Spark decides, tell little of rows in memory
BROADCAST_ROWS = 1 << 21

ORDER_ROLES = Roles(
    date="order_date", fundraiser="customer_id", country="country", device="channel", source="segment",
    gdv="revenue", complete="order_id", cost="cost",
)
EVENT_ROLES = Roles(
    date="ts", fundraiser="user_id", source="event_type", gdv="amount", nac2="signup", complete="purchase",
    view="view", click="click", cost="spend",
)

_STEPS = {"signup": "profile", "view": "etl", "click": "sql", "error": "anomaly", "purchase": "report"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, as Spark splits its files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every table as it lies on disk, for metadata and counts."""
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}


def _lines(spark: SparkSession, sf_dir: str, size: int = 0) -> DataFrame:
    """Order lines with their part and order; every query keeps only the columns it uses.

    The join with orders sorts in as many tasks as ``size``, the number of lines, asks for, if these are more than Spark's. Many
    parts are sorted and merged in such tasks too, instead of standing whole in the driver and in every executor.
    """
    lines, orders, parts = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    if parts.count() > BROADCAST_ROWS:
        lines, parts = deal_where_many(lines, "l_partkey", size or lines.count()), parts.hint("merge")
    priced = deal_where_many(lines.join(parts, lines.l_partkey == parts.p_partkey), "l_orderkey", size)
    return priced.join(orders, priced.l_orderkey == orders.o_orderkey)


def _order_columns() -> list[Column]:
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    exact = F.col("p_retailprice").cast("decimal(12,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    return [
        key.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.when((key * 7 + line) % 230 == 0, -1).otherwise(F.col("l_quantity").cast("int")).alias("quantity"),
        F.when((key * 11 + line) % 940 == 0, "N/A")
        .otherwise(exact.cast("decimal(18,4)").cast("string"))
        .alias("unit_price"),
        F.col("o_orderpriority").alias("channel"),
    ]


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*_order_columns())


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer, and the first ten customers once more."""
    people, nations = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    copies = F.when(key < 10, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        people.join(nations, people.c_nationkey == nations.n_nationkey)
        .select(
            key.alias("customer_id"),
            F.col("c_name").alias("name"),
            F.when(key % 33 != 0, F.format_string("c%d@example.com", key)).alias("email"),
            F.col("n_name").alias("country"),
            F.date_add(F.lit("1995-01-01").cast("date"), (key * 37 % 365).cast("int")).alias("signup_date"),
            F.explode(copies).alias("_copy"),
        )
        .drop("_copy")
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts_of(read(spark, sf_dir, "customer"))


def contacts_of(customers: DataFrame) -> DataFrame:
    """Contact data made from the customers' keys, for kinds of personal data that the texts lack.

    Every other card number repeats one digit, as test numbers do.
    """
    key = F.col("c_custkey")
    text = key.cast("string")

    def digits(value: Column, n: int) -> Column:
        return F.lpad((value % 10**n).cast("string"), n, "0")

    hashed = F.concat(F.md5(text), F.md5(F.concat(text, F.lit("x"))))
    return customers.select(
        key.alias("contact_id"),
        F.concat_ws("-", digits(key, 3), digits(key, 2), digits(key, 4)).alias("tax_id"),
        F.concat_ws("-", F.concat(F.lit("19"), digits(key, 2)), digits(key % 12 + 1, 2), digits(key % 28 + 1, 2)).alias("birth_date"),
        F.concat(F.lit("P"), digits(key, 7)).alias("passport_no"),
        F.concat(F.lit("D"), digits(key, 5)).alias("license"),
        F.concat(F.lit("ABC"), digits(key, 9)).alias("insurance"),
        F.concat(text, F.lit(" Main Street, "), digits(key, 5)).alias("address"),
        F.concat(F.lit("sk-"), F.md5(text)).alias("api_token"),
        F.concat(F.lit("h$2b$10$"), F.substring(hashed, 1, 53)).alias("password_hash"),
        F.when(key % 2 == 0, "1111-1111-1111-1111")
        .otherwise(F.concat(F.lit("4000-1234-"), digits(key, 4), F.lit("-5678")))
        .alias("card_number"),
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("list_price"),
    )


def raw_retail(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "orders": raw_orders(spark, sf_dir),
        "customers": raw_customers(spark, sf_dir),
        "products": raw_products(spark, sf_dir),
    }


def silver_retail(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    raw = raw_retail(spark, sf_dir)
    return {
        "orders": silver_orders(raw["orders"]),
        "customers": silver_customers(raw["customers"]),
        "products": silver_products(raw["products"], PART_CATEGORIES),
    }


def fact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid order lines with the dimensions of the weekly facts, dated by order and by shipment."""
    people, nations = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    size = read(spark, sf_dir, "lineitem").count()
    lines = _lines(spark, sf_dir, size).select(
        *_order_columns(), F.to_date("l_shipdate").alias("ship_date"), F.col("l_tax").cast("decimal(4,2)").alias("tax")
    )
    price = F.col("unit_price").try_cast("decimal(18,4)")
    valid = lines.where((F.col("quantity") > 0) & price.isNotNull())
    valid = valid.withColumn("revenue", (F.col("quantity") * price).cast("decimal(18,4)"))
    valid = valid.withColumn("cost", (F.col("revenue") * F.col("tax")).cast("decimal(18,6)"))
    homes = people.join(nations, people.c_nationkey == nations.n_nationkey).select(
        F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("segment")
    )
    return deal_by_fundraiser(valid, "customer_id", size).join(homes, "customer_id")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value").cast("decimal(18,2)")
    events = read(spark, sf_dir, "events")
    return deal_by_fundraiser(events.select("ts", "user_id", "event_type", "value"), "user_id", events.count()).select(
        "ts",
        "user_id",
        "event_type",
        F.when(kind == "purchase", value).alias("amount"),
        F.when(kind == "purchase", F.lit(1)).alias("purchase"),
        F.when(kind == "signup", F.lit(1)).alias("signup"),
        F.when(kind == "view", F.lit(1)).alias("view"),
        F.when(kind == "click", F.lit(1)).alias("click"),
        F.when(kind == "click", value).alias("spend"),
    )


def order_facts(spark: SparkSession, sf_dir: str, **bounds) -> DataFrame:
    return weekly_facts(fact_lines(spark, sf_dir), "ORDERS", ORDER_ROLES, **bounds)


def event_facts(spark: SparkSession, sf_dir: str, **bounds) -> DataFrame:
    """Events cover one month, so their period is the day."""
    return weekly_facts(event_rows(spark, sf_dir), "EVENTS", EVENT_ROLES, period="day", **bounds)


def _last_day(spark: SparkSession, sf_dir: str, table: str, column: str) -> Column:
    """The last day of a date column, as a scalar subquery."""
    return read(spark, sf_dir, table).agg(F.max(F.to_date(column)).alias("day")).scalar()


def _last_week(spark: SparkSession, sf_dir: str) -> Column:
    """The Monday of the last order, the common end of all sources."""
    return F.trunc(_last_day(spark, sf_dir, "orders", "o_orderdate"), "week")


def axis_end(spark: SparkSession, sf_dir: str) -> str | None:
    """The first day after the last week, from the data."""
    day = read(spark, sf_dir, "orders").agg(F.date_add(F.trunc(F.max(F.to_date("o_orderdate")), "week"), 7)).first()[0]
    return None if day is None else day.isoformat()


def event_week_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on the weeks of the orders: the last day with events stands for the last week, each day before it for a week before.

    Spending in the last week is four times what it was, so that the sources have something to warn of.
    """
    return weekly_facts(_event_weeks(spark, sf_dir), "EVENTS", replace(EVENT_ROLES, date="week"))


def _event_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    days_left = F.datediff(_last_day(spark, sf_dir, "events", "ts"), F.to_date("ts"))
    week = F.date_sub(_last_week(spark, sf_dir), 7 * days_left)
    rows = event_rows(spark, sf_dir).withColumn("week", week)
    return rows.withColumn("spend", F.col("spend") * F.when(days_left == 0, 4).otherwise(1))


def _shipment_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose shipments are dated so many whole weeks earlier that the last one falls in the last week."""
    last = F.trunc(_last_day(spark, sf_dir, "lineitem", "l_shipdate"), "week")
    behind = F.datediff(last, _last_week(spark, sf_dir))
    return fact_lines(spark, sf_dir).withColumn("ship_date", F.date_sub("ship_date", behind))


def all_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by order week and by ship week, and events, on one axis of weeks with one end; no row is left out.

    A table without dates drops out.
    """
    trade = weekly_facts_by_dates(_shipment_weeks(spark, sf_dir), {"ORDERS": "order_date", "SHIPMENTS": "ship_date"}, ORDER_ROLES)
    undated = weekly_facts(read(spark, sf_dir, "part"), "PARTS", Roles.discover(read(spark, sf_dir, "part")))
    return weekly_facts_union([trade, event_week_facts(spark, sf_dir), undated])


def discoverable_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame | None]:
    """Order lines and events under column names that tell their roles, a table without dates, and a missing one."""
    lines = fact_lines(spark, sf_dir).select(
        "order_date", F.col("customer_id").alias("fundraiser_id"), "country", F.col("channel").alias("device_name"),
        F.col("segment").alias("record_source"), F.col("revenue").alias("gdv"), F.col("order_id").alias("donation_id"), "cost",
    )
    renamed = {"user_id": "fundraiser_id", "event_type": "record_source", "signup": "nac2"}
    events = _event_weeks(spark, sf_dir).withColumnsRenamed(renamed).drop("ts")
    return {"ORDERS": lines, "EVENTS": events, "PARTS": read(spark, sf_dir, "part"), "GONE": None}


def channel_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly money and line count of valid orders, with two planted anomalies."""
    return seed_periods(weekly_series(weekly_channel_facts(raw_orders(spark, sf_dir))), "GDV", SEEDED_WEEKS)


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a run-event log: one run per user, one agent per event type."""
    return as_run_events(read(spark, sf_dir, "events"))


def as_run_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    step = F.lit("")
    for event_type, name in _STEPS.items():
        step = F.when(kind == event_type, name).otherwise(step)
    return events.select(
        "event_id",
        F.col("user_id").alias("run_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("agent"),
        step.alias("step"),
        F.when(kind == "error", "job_failed").when(kind == "purchase", "job_finished").otherwise("tool_call").alias("type"),
        F.when(kind == "error", "error").otherwise("ok").alias("status"),
        k.alias("tokens_in"),
        (k * 2).alias("tokens_out"),
        token_cost(k, k * 2).alias("cost_usd"),
        (F.col("value").cast("decimal(18,2)") / 100).cast("decimal(18,4)").alias("duration_s"),
    )


def vector_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("category")
    )
