"""Run a registered query next to its SQL counterpart."""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb

from weftmark.plans.inputs import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, datetime | date):
        return value.isoformat()
    return value


def as_set(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    kept = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(kept, key=repr)


# Spark type -> DuckDB type
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def compare(df, con, sql):
    """None when equal, else a short text."""
    cursor = con.execute(sql)
    described = {d[0]: str(d[1]) for d in cursor.description}
    want = as_set(list(described), cursor.fetchall())
    got = as_set(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    types = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields}
    if types != described:
        return f"types {types} != {described}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(wrong)} rows differ, first: {wrong[0][0]} != {wrong[0][1]}" if wrong else None
