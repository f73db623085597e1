"""Bronze, silver and gold in one call."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from weftmark.operators import clean, marts


def medallion(raw: Mapping[str, DataFrame], categories: Iterable[str] = clean.RETAIL_CATEGORIES) -> dict[str, DataFrame]:
    """All layers as named lazy frames; nothing runs until one of them is written or read."""
    orders = clean.silver_orders(raw["orders"])
    customers = clean.silver_customers(raw["customers"])
    products = clean.silver_products(raw["products"], categories)
    return {
        **{f"bronze_{name}": df for name, df in raw.items()},
        "silver_orders": orders,
        "silver_customers": customers,
        "silver_products": products,
        "gold_weekly_sales": marts.gold_weekly_sales(orders),
        "gold_customer_metrics": marts.gold_customer_metrics(customers, orders),
        "gold_category_performance": marts.gold_category_performance(products, orders),
    }


def metric_tables(layers: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables metrics are defined on: the layers plus valid orders (with country) and orders per customer."""
    from pyspark.sql import functions as F

    orders = clean.valid_lines(layers["silver_orders"])
    homes = layers["silver_customers"].groupBy("customer_id").agg(F.min("country").alias("country"))
    per_customer = layers["silver_orders"].groupBy("customer_id").agg(F.count("*").alias("orders"))
    return {
        **layers,
        "valid_orders": orders,
        "valid_orders_by_country": orders.join(homes, "customer_id", "left"),
        "customer_orders": per_customer,
    }


def run_medallion(
    raw: Mapping[str, DataFrame], database: str, categories: Iterable[str] = clean.RETAIL_CATEGORIES, prefix: str = ""
) -> dict[str, DataFrame]:
    """Save silver as tables, build gold from the saved tables and save it; gives the saved tables.

    Raw data is read once for each silver table, however many gold tables there are.
    """
    def saved(name: str, df: DataFrame) -> DataFrame:
        table = f"{database}.{prefix}{name}"
        df.write.mode("overwrite").saveAsTable(table)
        return df.sparkSession.table(table)

    layers = medallion(raw, categories)
    silver = {n: saved(n, df) for n, df in layers.items() if n.startswith("silver_")}
    orders, customers, products = (silver[f"silver_{n}"] for n in ("orders", "customers", "products"))
    gold = {
        "gold_weekly_sales": marts.gold_weekly_sales(orders),
        "gold_customer_metrics": marts.gold_customer_metrics(customers, orders),
        "gold_category_performance": marts.gold_category_performance(products, orders),
    }
    return {**silver, **{n: saved(n, df) for n, df in gold.items()}}
