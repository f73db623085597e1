"""Table profiles and statistical quality checks."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmark.functions.bitmaps import rows_in_map
from weftmark.functions.numbers import half_up, price, ratio
from weftmark.functions.ordering import top_by
from weftmark.functions.quantiles import exact_quantiles, value_counts
from weftmark.operators.clean import orders_clean
from weftmark.operators.marts import week_of
from weftmark.session import materialize

NO_DESCRIPTION = "—"  # fixed value

# Known column descriptions by table and column.
DESCRIPTIONS = {
    ("orders", "order_id"): "Unique order identifier",
    ("orders", "customer_id"): "Foreign key to customers",
    ("orders", "product_id"): "Foreign key to products",
    ("orders", "order_date"): "Date the order was placed",
    ("orders", "quantity"): "Number of units ordered",
    ("orders", "unit_price"): "Price per unit (may contain dirty data)",
    ("orders", "channel"): "Sales channel (web, mobile, partner)",
    ("customers", "customer_id"): "Unique customer identifier",
    ("customers", "name"): "Customer display name",
    ("customers", "email"): "Email address (may contain nulls)",
    ("customers", "country"): "Country code (US, IN, DE, UK)",
    ("customers", "signup_date"): "Date of customer registration",
    ("products", "product_id"): "Unique product identifier",
    ("products", "product_name"): "Product display name",
    ("products", "category"): "Product category (Electronics, Home, Toys, Office)",
    ("products", "list_price"): "Standard list price",
}


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def profile_table(df: DataFrame, table: str) -> DataFrame:
    """One row per column: position, type, row count and null count, from a single pass."""
    counted = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(i + 1).alias("position"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.col(f"n{i}").alias("null_count"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return counted.select(F.lit(table).alias("table_name"), F.col("rows").alias("row_count"), F.inline(rows))


def profile_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_all([profile_table(df, name) for name, df in tables.items()])


def null_findings(tables: Mapping[str, DataFrame], high_share: float = 0.1) -> DataFrame:
    severe = F.col("null_count") > F.col("row_count") * F.lit(high_share)
    return (
        profile_tables(tables)
        .where("null_count > 0")
        .select(
            "table_name",
            "column_name",
            F.lit("null_count").alias("check"),
            F.col("null_count").alias("value"),
            F.when(severe, "high").otherwise("low").alias("severity"),
        )
    )


def _row_hashes(df: DataFrame) -> list[Column]:
    """128 bits of a row, nulls by their place."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    return [F.xxhash64(*columns, nulls), F.xxhash64(nulls, *reversed(columns))]


def repeated_rows(df: DataFrame, hashes: DataFrame, count: int | None = None) -> DataFrame:
    """(rows, distinct) among the rows that have one of the repeated ``hashes`` (h1, h2); rows are compared as a whole."""
    columns = [f"c{i}" for i in range(len(df.columns))]
    own = df.toDF(*columns).select("*", *[h.alias(n) for h, n in zip(_row_hashes(df.toDF(*columns)), ("h1", "h2"))])
    groups = rows_in_map(own, F.col("h1"), hashes, "h1", count=count).groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct"))


def duplicate_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows minus distinct rows per table, where that is not zero.

    Hashes of all rows are counted first. Only rows whose hash repeats are then moved and compared as a whole, so hashes that
    meet by chance do not matter.
    """
    spark = next(iter(tables.values())).sparkSession
    hashed = [
        df.select(F.lit(name).alias("table_name"), *[h.alias(n) for h, n in zip(_row_hashes(df), ("h1", "h2"))])
        for name, df in tables.items()
    ]
    counts = union_all(hashed).groupBy("table_name", "h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    repeated = materialize(counts.select("table_name", "h1", "h2"), "repeated")
    none = spark.createDataFrame([], "table_name string, value bigint")
    found = [none]
    for name, count in repeated.groupBy("table_name").count().collect():  # a row for each table at most
        here = repeated_rows(tables[name], repeated.where(F.col("table_name") == name).select("h1", "h2"), count)
        found.append(here.select(F.lit(name).alias("table_name"), (F.col("rows") - F.col("distinct")).alias("value")))
    return union_all(found).where("value > 0").select(
        "table_name", F.lit("duplicate_rows").alias("check"), "value", F.lit("medium").alias("severity")
    )


def iqr_outliers(orders: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """One row: Tukey fences of the price column and how many prices lie outside."""
    prices = value_counts(orders.select(price(F.col("unit_price")).alias("p")), "p")
    quartiles = exact_quantiles(prices, [0.25, 0.75])
    reach = (F.col("q1") - F.col("q0")) * multiplier
    fences = quartiles.select(
        F.struct((F.col("q0") - reach).alias("lower"), (F.col("q1") + reach).alias("upper"))
    ).scalar()
    placed = prices.withColumn("f", fences)
    outside = (F.col("v") < F.col("f.lower")) | (F.col("v") > F.col("f.upper"))
    return placed.agg(
        F.max("f.lower").alias("lower_bound"),
        F.max("f.upper").alias("upper_bound"),
        F.coalesce(F.sum(F.when(outside, F.col("c"))), F.lit(0)).alias("outliers"),
        F.sum("c").alias("total"),
    ).where("total > 3")


# size of the quantile sketch, and the error of a rank that it promises with 99 per cent, as a share of all values
SKETCH_K = 800
SKETCH_ERROR = 0.01
# ranks at which the sketch is read
SKETCH_RANKS = 1000


def iqr_outliers_sketch(orders: DataFrame, multiplier: float = 1.5, k: int = SKETCH_K) -> DataFrame:
    """``iqr_outliers`` from one pass: quartiles, fences and the number outside of them by a mergeable sketch.

    Every task fills a sketch of a few thousand numbers, and these are merged, so nothing else is moved or read again. Ranks, and
    with them the number of outliers, are right up to ``SKETCH_ERROR`` of all values. Columns: q1, q3, lower_bound,
    upper_bound, outliers, total.
    """
    value = price(F.col("unit_price")).cast("double")
    sketch = F.kll_sketch_agg_double(value, k)
    made = orders.where(value.isNotNull()).agg(sketch.alias("s"), F.count("*").alias("total")).where("total > 3")
    # values at evenly spaced ranks; the quartiles are among them
    ranks = F.array(*[F.lit(i / SKETCH_RANKS) for i in range(SKETCH_RANKS + 1)])
    made = made.select("total", F.kll_sketch_get_quantile_double("s", ranks).alias("at"))
    made = made.select("*", *[F.element_at("at", SKETCH_RANKS * i // 4 + 1).alias(f"q{i}") for i in (1, 3)])
    reach = (F.col("q3") - F.col("q1")) * multiplier
    made = made.withColumn("lower_bound", F.col("q1") - reach).withColumn("upper_bound", F.col("q3") + reach)
    outside = F.filter("at", lambda v: (v < F.col("lower_bound")) | (v > F.col("upper_bound")))
    outliers = F.round(F.size(outside) / (SKETCH_RANKS + 1) * F.col("total")).cast("bigint")
    return made.select("q1", "q3", "lower_bound", "upper_bound", outliers.alias("outliers"), "total")


# -- whole-series checks on weekly sums ---------------------------------------------------------------------


def _weekly_pairs(orders: DataFrame) -> DataFrame:
    """Long form (metric, week, value) of weekly revenue and order count; one row per week and metric."""
    weekly = (
        orders_clean(orders)
        .groupBy(week_of(F.col("order_date")).alias("week"))
        .agg(F.sum("revenue").cast("double").alias("GDV"), F.count("*").cast("double").alias("Order Count"))
    )
    return weekly.unpivot("week", ["GDV", "Order Count"], "metric", "actual")


def _found(df: DataFrame, detector: str, size: Column, limit: float, high: float, weeks: int) -> DataFrame:
    return df.where((F.col("weeks") >= weeks) & (size > limit)).select(
        "metric",
        F.lit(detector).alias("detector"),
        "week",
        F.when(size > high, "high").otherwise("medium").alias("severity"),
        size.alias("size"),
        "actual",
        F.col("reference"),
    )


def pct_change_anomalies(orders: DataFrame) -> DataFrame:
    """Weeks that differ from the week before by more than 50 %; needs 4 weeks."""
    per_metric = Window.partitionBy("metric")
    series = _weekly_pairs(orders).select(
        "*",
        F.lag("actual").over(per_metric.orderBy("week")).alias("reference"),
        F.count("*").over(per_metric).alias("weeks"),
    )
    change = F.abs((F.col("actual") - F.col("reference")) / F.greatest(F.col("reference"), F.lit(1.0))) * 100
    return _found(series, "pct_change", change, 50.0, 100.0, weeks=4)


def zscore_anomalies(orders: DataFrame) -> DataFrame:
    """Weeks more than two population deviations from the mean of the series; needs more than 4 weeks."""
    per_metric = Window.partitionBy("metric")
    series = _weekly_pairs(orders).select(
        "*",
        F.avg("actual").over(per_metric).alias("reference"),
        F.stddev_pop("actual").over(per_metric).alias("sd"),
        F.count("*").over(per_metric).alias("weeks"),
    )
    z = F.abs(ratio(F.col("actual") - F.col("reference"), F.col("sd")))
    return _found(series, "z_score", z, 2.0, 3.0, weeks=5)


def top_findings(orders: DataFrame, n: int = 5) -> DataFrame:
    found = pct_change_anomalies(orders).unionByName(zscore_anomalies(orders))
    return top_by(found, half_up(F.col("size"), 4), n, "metric", "detector", "week")


# -- documentation tables -----------------------------------------------------------------------------------


def data_dictionary(
    tables: Mapping[str, DataFrame], descriptions: Mapping[tuple[str, str], str] = DESCRIPTIONS
) -> DataFrame:
    """Profile plus a description per known column. The lookup is metadata, so it is a literal expression."""
    text = F.lit(NO_DESCRIPTION)
    for (table, column), words in descriptions.items():
        hit = (F.col("table_name") == table) & (F.col("column_name") == column)
        text = F.when(hit, words).otherwise(text)
    return profile_tables(tables).select(
        "table_name", "column_name", "data_type", "null_count", text.alias("description")
    )


def schema_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Table, row count and its columns in order."""

    def one(df: DataFrame, table: str) -> DataFrame:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.agg(F.count("*").alias("row_count")).select(
            F.lit(table).alias("table_name"), "row_count", F.lit(columns).alias("columns")
        )

    return union_all([one(df, name) for name, df in tables.items()])
