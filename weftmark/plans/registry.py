"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, FloatType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with SQL that gives the same rows where there is such SQL."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def snap(value: Column, digits: int) -> Column:
    """Cut a double to a grid for comparison.

    The boundary lies slightly beside one half, so that ties and rounding noise fall the same way in both engines.
    """
    scale = float(10**digits)
    return F.floor(value.cast("double") * F.lit(scale) + F.lit(0.50007)) / F.lit(scale)


def snap_sql(value: str, digits: int) -> str:
    scale = f"{10**digits}e0"
    return f"floor(CAST({value} AS DOUBLE) * {scale} + 0.50007) / {scale}"


def comparable(df: DataFrame, digits: int | None = None, **per_column: int) -> DataFrame:
    """Decimals as doubles, arrays as joined text, and doubles on a grid where wanted."""
    columns = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ArrayType):
            value = F.array_join(value, "|")
        elif isinstance(f.dataType, DecimalType):
            value = value.cast("double")
        if isinstance(f.dataType, DecimalType | DoubleType | FloatType):
            places = per_column.get(f.name, digits)
            if places is not None:
                value = snap(value, places)
        columns.append(value.alias(f.name))
    return df.select(*columns)
