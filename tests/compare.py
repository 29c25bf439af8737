"""Run registered queries beside their DuckDB counterparts and compare whole results."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

SPARK_TO_DUCKDB = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float) and value == 0:
        return "0.0"
    return repr(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences between the two results; empty when names, types and all values agree."""
    relation = con.sql(sql)
    names, types = relation.columns, [str(t) for t in relation.types]
    expected_columns, expected = _table(names, relation.fetchall())
    columns, found = _table(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if columns != expected_columns:
        return [f"columns {sorted(set(columns) ^ set(expected_columns))}"]
    kinds = dict(zip(names, types))
    for name, kind in df.dtypes:
        if SPARK_TO_DUCKDB.get(kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} and {kinds[name]}")
    if len(found) != len(expected):
        problems.append(f"rows {len(found)} and {len(expected)}")
    if found != expected:
        left, right = sorted(set(found) - set(expected)), sorted(set(expected) - set(found))
        problems.append(f"values: {len(left)} only here, {len(right)} only in the oracle; {left[:2]} ... {right[:2]}")
    return problems
