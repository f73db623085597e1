"""Gold layer marts and the canned business questions and reports.

Shapes used throughout: facts are reduced on their join key before they meet a dimension table wherever the
measures allow it, money is summed as exact decimal, and distinct counts are left to Spark's two-step plan
(first on group and value, then on group), which spreads a hot group over all tasks. No join side carries a
broadcast hint: dimension tables grow, so the measured size decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.functions.numbers import half_up, money, one_row, ratio
from weftmark.functions.ordering import top_by
from weftmark.operators.clean import orders_clean, silver_orders, valid_lines


def week_of(day: Column) -> Column:
    """The Monday of a date."""
    return F.to_date(F.date_trunc("week", day))


def _revenue() -> Column:
    return money(F.sum("revenue")).alias("revenue")


def _percent(part: Column, whole: Column, digits: int) -> Column:
    return half_up(ratio(part * 100.0, whole), digits)


# -- marts ------------------------------------------------------------------------------------------------


def gold_weekly_sales(silver: DataFrame) -> DataFrame:
    return (
        valid_lines(silver)
        .groupBy(week_of(F.col("order_date")).alias("week"))
        .agg(
            _revenue(),
            F.count("*").alias("order_count"),
            F.countDistinct("customer_id").alias("unique_customers"),
        )
    )


def gold_customer_metrics(silver_customers: DataFrame, silver: DataFrame) -> DataFrame:
    """Customers without valid orders stay, with null money and zero orders.

    Orders are totalled per customer before the join; the customer columns are then unique per customer
    unless the table itself repeats a customer, which the outer grouping settles.
    """
    totals = (
        valid_lines(silver)
        .groupBy("customer_id")
        .agg(F.sum("revenue").alias("spent"), F.count("order_id").alias("n"))
    )
    return (
        silver_customers.join(totals, "customer_id", "left")
        .groupBy("customer_id", "name", "country")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_orders"),
            money(F.sum("spent")).alias("lifetime_value"),
            half_up(ratio(F.sum("spent"), F.sum("n")), 2).alias("avg_order_value"),
        )
    )


def gold_category_performance(silver_products: DataFrame, silver: DataFrame) -> DataFrame:
    """Joined first: products usually fit a broadcast, and the distinct count then reduces on (category, customer)."""
    joined = valid_lines(silver).join(silver_products.select("product_id", "category"), "product_id")
    return (
        joined.groupBy("category")
        .agg(
            _revenue(),
            F.count("*").alias("order_count"),
            F.countDistinct("customer_id").alias("unique_customers"),
        )
        .orderBy(F.col("revenue").desc(), "category")
    )


def mart_totals(weekly: DataFrame, customers: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per mart; measures a mart does not have are null."""

    def row(df: DataFrame, mart: str, total: Column, week: Column, life: Column) -> DataFrame:
        return df.agg(
            F.lit(mart).alias("mart"),
            F.count("*").alias("row_count"),
            total.cast("double").alias("total_revenue"),
            week.cast("double").alias("avg_weekly_revenue"),
            life.cast("double").alias("avg_lifetime_value"),
        )

    def cents(c: str) -> Column:
        return F.col(c).cast("decimal(28,2)")

    none = F.lit(None)
    return (
        row(
            weekly,
            "gold_weekly_sales",
            F.sum(cents("revenue")),
            half_up(ratio(F.sum(cents("revenue")), F.count("revenue")), 2),
            none,
        )
        .unionByName(
            row(
                customers,
                "gold_customer_metrics",
                none,
                none,
                half_up(ratio(F.sum(cents("lifetime_value")), F.count("lifetime_value")), 2),
            )
        )
        .unionByName(row(categories, "gold_category_performance", F.sum(cents("revenue")), none, none))
    )


# -- business questions -----------------------------------------------------------------------------------


def _per_product(orders: DataFrame) -> DataFrame:
    return orders_clean(orders).groupBy("product_id").agg(F.sum("revenue").alias("revenue"))


def top_products(orders: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    named = _per_product(orders).join(products, "product_id").groupBy("product_name", "category").agg(_revenue())
    return top_by(named, F.col("revenue"), n, "product_name", "category")


def category_revenue(orders: DataFrame, products: DataFrame) -> DataFrame:
    joined = _per_product(orders).join(products, "product_id")
    return joined.groupBy("category").agg(_revenue()).orderBy(F.col("revenue").desc(), "category")


def monthly_revenue(orders: DataFrame) -> DataFrame:
    month = F.date_format("order_date", "yyyy-MM").alias("month")
    return orders_clean(orders).groupBy(month).agg(_revenue(), F.count("*").alias("order_count")).orderBy("month")


def weekly_revenue_trend(orders: DataFrame) -> DataFrame:
    week = week_of(F.col("order_date")).alias("week")
    return orders_clean(orders).groupBy(week).agg(_revenue(), F.count("*").alias("order_count")).orderBy("week")


def repeat_customer_rate(orders: DataFrame) -> DataFrame:
    per_customer = orders.groupBy("customer_id").count()
    repeat = F.count_if(F.col("count") > 1)
    return per_customer.agg(
        _percent(repeat, F.count("*"), 1).alias("repeat_customer_pct"),
        F.count("*").alias("total_customers"),
        repeat.alias("repeat_customers"),
    )


def revenue_by_channel(orders: DataFrame) -> DataFrame:
    return (
        orders_clean(orders)
        .groupBy("channel")
        .agg(_revenue(), F.count("*").alias("orders"))
        .orderBy(F.col("revenue").desc(), "channel")
    )


def revenue_by_country(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """``customers`` must hold one row per customer, else revenue is counted twice."""
    per_customer = (
        orders_clean(orders)
        .groupBy("customer_id")
        .agg(F.sum("revenue").alias("revenue"), F.count("*").alias("n"))
    )
    return (
        per_customer.join(customers.select("customer_id", "country"), "customer_id")
        .groupBy("country")
        .agg(_revenue(), F.sum("n").alias("orders"))
        .orderBy(F.col("revenue").desc(), "country")
    )


def entity_counts(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    return one_row(
        customers.agg(F.countDistinct("customer_id").alias("total_customers")),
        products.agg(F.count("*").alias("total_products")),
        orders.agg(F.count("*").alias("total_orders")),
    )


def avg_order_value(orders: DataFrame) -> DataFrame:
    """Mean over orders of the order's total."""
    totals = orders_clean(orders).groupBy("order_id").agg(F.sum("revenue").alias("order_total"))
    mean = half_up(ratio(F.sum("order_total"), F.count("order_total")), 2)
    return totals.agg(mean.alias("avg_order_value"))


# -- reports ----------------------------------------------------------------------------------------------


def kpi_report(orders: DataFrame) -> DataFrame:
    """One row; the mean value is over rows, not over orders."""
    return orders_clean(orders).agg(
        F.countDistinct("customer_id").alias("active_customers"),
        F.count("*").alias("total_orders"),
        half_up(ratio(F.sum("revenue"), F.count("*")), 2).alias("avg_order_value"),
        money(F.sum("revenue")).alias("total_revenue"),
    )


def executive_facts(orders: DataFrame) -> DataFrame:
    """One row of headline numbers.

    Every figure comes from one of two small aggregates: totals per week and totals per customer.
    """
    silver = silver_orders(orders)
    valid = F.col("quantity").isNotNull() & F.col("unit_price").isNotNull()
    line = F.when(valid, (F.col("quantity") * F.col("unit_price")).cast("decimal(18,4)"))
    weekly = silver.groupBy(week_of(F.col("order_date")).alias("week")).agg(
        F.sum(line).alias("exact"),
        money(F.sum(line)).alias("revenue"),
        F.count_if(valid).alias("valid"),
        F.count("*").alias("n"),
        F.count_if(F.col("quantity").isNull()).alias("bad_quantity"),
        F.count_if(F.col("unit_price").isNull()).alias("bad_price"),
    )
    has_week = F.col("valid") > 0
    cents = F.when(has_week, F.col("revenue").cast("decimal(28,2)"))
    by_week = weekly.agg(
        F.count_if(has_week).alias("periods"),
        money(F.sum("exact")).alias("total_revenue"),
        half_up(ratio(F.sum(cents), F.count(cents)), 2).alias("avg_weekly_revenue"),
        F.max_by(F.when(has_week, F.col("revenue")), F.when(has_week, F.col("week"))).alias("latest_revenue"),
        F.sum("n").alias("total_orders"),
        F.sum("bad_quantity").alias("bad_quantity"),
        F.sum("bad_price").alias("bad_price"),
    )
    by_customer = orders.groupBy("customer_id").count().agg(
        F.count("customer_id").alias("active_customers"),
        F.count_if(F.col("count") > 1).alias("repeat_customers"),
    )
    latest, mean = F.col("latest_revenue"), F.col("avg_weekly_revenue")
    trend = F.when(latest > mean, "up").when(latest < mean, "down").otherwise("flat")
    return one_row(by_week, by_customer).select(
        "*",
        trend.alias("trend"),
        _percent(F.col("bad_quantity"), F.col("total_orders"), 1).alias("bad_quantity_pct"),
        _percent(F.col("bad_price"), F.col("total_orders"), 1).alias("bad_price_pct"),
        _percent(F.col("repeat_customers"), F.col("active_customers"), 1).alias("repeat_rate"),
    )


def breakeven_by_group(
    orders: DataFrame, fixed_cost_per_month: float, ramp_months: int = 6, group: str = "channel"
) -> DataFrame:
    """Per group and month: ramped income minus cost, its running total, and the first month above zero."""
    from pyspark.sql import Window

    monthly = (
        orders_clean(orders)
        .groupBy(group, F.date_format("order_date", "yyyy-MM").alias("month"))
        .agg(F.sum("revenue").cast("double").alias("income"))
    )
    # one row per month from here on
    by_month = Window.partitionBy(group).orderBy("month")
    numbered = monthly.withColumn("month_no", F.row_number().over(by_month))
    ramp = F.least(F.lit(1.0), F.col("month_no") / F.lit(float(max(ramp_months, 1))))
    net = numbered.withColumn("net", F.col("income") * ramp - F.lit(float(fixed_cost_per_month)))
    running = net.withColumn("cumulative", F.sum("net").over(by_month.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("cumulative") > 0, F.col("month_no"))).over(Window.partitionBy(group))
    return running.withColumn("payback_month", first)
