"""Silver layer: cleaning policies for the three raw retail tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.functions.numbers import number, one_row, price

# Fixed values.
UNKNOWN_EMAIL = "unknown@unknown.com"
RETAIL_CATEGORIES = ("Electronics", "Home", "Toys", "Office")
OTHER_CATEGORY = "Other"


def silver_orders(orders: DataFrame) -> DataFrame:
    """Keep every row; a non-positive quantity or a price that is no number becomes null."""
    return orders.select(
        "order_id",
        "customer_id",
        "product_id",
        F.to_date("order_date").alias("order_date"),
        F.when(F.col("quantity") > 0, F.col("quantity")).alias("quantity"),
        price(F.col("unit_price")).alias("unit_price"),
        "channel",
    )


def valid_lines(silver: DataFrame) -> DataFrame:
    """Silver rows with quantity and price, plus their exact revenue."""
    kept = silver.where(F.col("quantity").isNotNull() & F.col("unit_price").isNotNull())
    return kept.withColumn("revenue", (F.col("quantity") * F.col("unit_price")).cast("decimal(18,4)"))


def orders_clean(orders: DataFrame) -> DataFrame:
    """The other policy: drop the bad rows and add revenue."""
    return valid_lines(silver_orders(orders))


def silver_customers(customers: DataFrame) -> DataFrame:
    """Fill missing e-mails, then drop rows that repeat in all five columns."""
    return customers.select(
        "customer_id",
        "name",
        F.coalesce("email", F.lit(UNKNOWN_EMAIL)).alias("email"),
        "country",
        "signup_date",
    ).distinct()


def customers_clean(customers: DataFrame) -> DataFrame:
    return customers.dropDuplicates()


def silver_products(products: DataFrame, categories: Iterable[str] = RETAIL_CATEGORIES) -> DataFrame:
    """A category that is unknown or null becomes ``Other``."""
    known = F.col("category").isin(*categories)
    return products.select(
        "product_id",
        "product_name",
        F.when(known, F.col("category")).otherwise(F.lit(OTHER_CATEGORY)).alias("category"),
        "list_price",
    )


def silver_quality_report(
    orders: DataFrame, customers: DataFrame, products: DataFrame, categories: Iterable[str] = RETAIL_CATEGORIES
) -> DataFrame:
    """One row of counts. Null categories are not counted as bad, although they are rewritten."""
    silver = silver_orders(orders).agg(
        F.count("*").alias("total_orders"),
        F.count_if(F.col("quantity").isNull()).alias("bad_quantity"),
        F.count_if(F.col("unit_price").isNull()).alias("bad_price"),
        F.count_if(F.col("order_date").isNull()).alias("null_dates"),
    )
    filled = customers.withColumn("email", F.coalesce("email", F.lit(UNKNOWN_EMAIL)))
    copies = filled.groupBy("customer_id", "name", "email", "country", "signup_date").count()
    people = copies.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_customers"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_customers"),
    )
    goods = products.agg(
        F.count("*").alias("total_products"),
        F.count_if(~F.col("category").isin(*categories)).alias("bad_categories"),
    )
    return one_row(silver, people, goods)


def safe_timestamp(df: DataFrame, column: str) -> Column:
    """A date or timestamp column as it is, anything else parsed; unparsable text becomes null."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.col(column).cast("timestamp")
    return F.try_to_timestamp(F.col(column).cast("string"))


def safe_number_sum(df: DataFrame, column: str) -> Column:
    """Sum of a numeric column, or of the parsable values of a text column."""
    kind = df.schema[column].dataType.typeName()
    if kind == "string":
        return F.sum(number(F.col(column)))
    return F.sum(column)
