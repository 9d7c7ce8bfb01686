"""Comparing query results with DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def normal(value):
    """Values in one form: whole doubles and integers differ in type, not in value."""
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    return value


def table_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(normal(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(shaped, key=repr)


def spark_table(df) -> tuple[list[str], list[tuple]]:
    return table_of(df.columns, df.collect())


def duck_table(connection, sql: str) -> tuple[list[str], list[tuple]]:
    found = connection.execute(sql)
    return table_of([column[0] for column in found.description], found.fetchall())
