"""Catalog views: manifests, schema drift and column lists."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.operators.profile import profile_tables, union_all


def schema_hash(df: DataFrame) -> str:
    """SHA-256 over the sorted ``name:type`` pairs: the same schema always gives the same hash."""
    signature = ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields))
    return hashlib.sha256(signature.encode()).hexdigest()


def bronze_manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table and column: type, row count, null count and the table's schema hash."""
    hashed = F.lit(None).cast("string")
    for name, df in tables.items():
        hashed = F.when(F.col("table_name") == name, schema_hash(df)).otherwise(hashed)
    return profile_tables(tables).select(
        "table_name", "column_name", "position", "data_type", "row_count", "null_count", hashed.alias("schema_hash")
    )


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns added, removed or retyped between two manifests, with the rows and nulls that they had and have."""
    key = ["table_name", "column_name"]

    def side(manifest: DataFrame, name: str) -> DataFrame:
        renamed = {"data_type": f"{name}_type", "row_count": f"{name}_rows", "null_count": f"{name}_nulls"}
        return manifest.select(*key, *[F.col(c).alias(n) for c, n in renamed.items()])

    before, after = side(old, "old"), side(new, "new")
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    )
    return before.join(after, key, "full_outer").withColumn("change", change).where("change IS NOT NULL")


def catalog_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Table, column, type and position, with the row count of the table."""

    def one(df: DataFrame, table: str) -> DataFrame:
        columns = F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("data_type"),
                    F.lit(i + 1).alias("position"),
                )
                for i, f in enumerate(df.schema.fields)
            ]
        )
        return df.agg(F.count("*").alias("row_count")).select(
            F.lit(table).alias("table_name"), F.inline(columns), "row_count"
        )

    return union_all([one(df, name) for name, df in tables.items()])
