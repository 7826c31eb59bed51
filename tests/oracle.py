"""Compares a Spark result with a DuckDB one: same columns, same rows in any order, same kinds of values."""

from __future__ import annotations

import datetime as dt
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


# Spark and DuckDB names of the same types.
SAME_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _kind(value) -> str:
    return type(value).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is not None, _kind(v), str(v)) for v in r))


def compare(name, spark_df, con, sql) -> str | None:
    """None if equal, else what differs."""
    columns = spark_df.columns
    types = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    cursor = con.execute(sql)
    other = [c[0] for c in cursor.description]
    if sorted(columns) != sorted(other):
        return f"{name}: columns {sorted(columns)} != {sorted(other)}"
    for column, kind in spark_df.dtypes:
        if SAME_TYPES.get(kind) != types[column]:
            return f"{name}: {column} is {kind}, not {types[column]}"
    mine, theirs = rows_of(columns, spark_df.collect()), rows_of(other, cursor.fetchall())
    if len(mine) != len(theirs):
        return f"{name}: {len(mine)} rows != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b or [_kind(v) for v in a] != [_kind(v) for v in b]:
            return f"{name}: {str(a)[:600]} != {str(b)[:600]}"
    return None
