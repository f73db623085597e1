"""CSV tables, JSON event logs, saved tables and ad-hoc SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftmark.config import DetectorParams

JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

RAW_SCHEMAS = {
    "orders": (
        "order_id bigint, customer_id bigint, product_id bigint, order_date date, quantity int, "
        "unit_price string, channel string"
    ),
    "customers": "customer_id bigint, name string, email string, country string, signup_date date",
    "products": "product_id bigint, product_name string, category string, list_price double",
}

EVENT_SCHEMA = (
    "event_id bigint, run_id bigint, ts timestamp, agent string, step string, type string, status string, "
    "tokens_in bigint, tokens_out bigint, cost_usd decimal(18,6), duration_s decimal(18,4)"
)


def read_csv_tables(
    spark: SparkSession,
    folder: str,
    tables: Sequence[str] = ("orders", "customers", "products"),
    schemas: Mapping[str, str | StructType] | None = None,
) -> dict[str, DataFrame]:
    """Raw tables from ``folder/<table>.csv`` (a file or a folder of part files) with a header line.

    A table without a given schema has its types inferred, which costs one more pass over its files.
    """
    loaded = {}
    for table in tables:
        reader = spark.read.option("header", True)
        known = (schemas or {}).get(table)
        reader = reader.schema(known) if known is not None else reader.option("inferSchema", True)
        loaded[table] = reader.csv(f"{folder}/{table}.csv")
    return loaded


def write_csv_table(df: DataFrame, folder: str, table: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/{table}.csv")


def write_event_log(events: DataFrame, path: str) -> None:
    """Append run events as JSON lines."""
    events.write.mode("append").option("timestampFormat", JSON_TIME).json(path)


def read_event_log(spark: SparkSession, path: str, schema: str | StructType = EVENT_SCHEMA) -> DataFrame:
    """Run events from JSON lines; fields missing in a line are null."""
    return spark.read.schema(schema).option("timestampFormat", JSON_TIME).json(path)


def stream_event_log(spark: SparkSession, path: str, schema: str | StructType = EVENT_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).option("timestampFormat", JSON_TIME).json(path)


def save_with_provenance(
    df: DataFrame,
    table: str,
    description: str = "",
    params: DetectorParams = DetectorParams(),
    generator: str = "weftmark",
    folder: str | None = None,
) -> str:
    """Overwrite a table and record where it came from in its comment; an empty input is skipped.

    The rows are computed and written once, to a new folder below ``folder`` (the warehouse, if none is given), and
    counted on the way. Only then does the table move to that folder, so readers never see a half-written table; a table
    whose columns stay the same is there all the time. Folders of earlier versions are left to the readers they may have.
    """
    spark = df.sparkSession
    root = folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_versions/{table}"
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    rows = seen.get["rows"]
    if rows == 0:
        return table
    if spark.catalog.tableExists(table) and spark.table(table).schema.simpleString() == df.schema.simpleString():
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
        spark.catalog.refreshTable(table)
    else:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.catalog.createTable(table, path=path, source="parquet", schema=df.schema)
    comment = {
        "description": description,
        "generated_by": generator,
        "generated_at": datetime.now(UTC).isoformat(),
        "lookback_weeks": params.lookback_weeks,
        "baseline_weeks": params.baseline_weeks,
        "row_count": rows,
        "columns": df.columns,
    }
    spark.sql(f"COMMENT ON TABLE {table} IS :note", args={"note": json.dumps(comment)})
    return table


def read_provenance(spark: SparkSession, table: str) -> dict:
    return json.loads(spark.catalog.getTable(table).description)


def adhoc_sql(spark: SparkSession, query: str, tables: Mapping[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Run a query over the given tables, written in braces (``FROM {orders}``); all rows, or ``limit`` for display."""
    used = {name: df for name, df in tables.items() if "{" + name + "}" in query}
    found = spark.sql(query, **used)
    return found if limit is None else found.limit(limit)


def sample_rows(df: DataFrame, key: Sequence[str], n: int = 5) -> DataFrame:
    """The first rows by a key, all values as text."""
    return df.orderBy(*key).limit(n).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
