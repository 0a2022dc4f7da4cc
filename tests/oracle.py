"""Compare a query with its SQL: columns by name, types by family, rows as a bag."""

from __future__ import annotations

import collections
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(
        tuple((type(row[i]).__name__, _plain(row[i])) for i in order) for row in rows
    )


def compare(spark_df, connection, sql: str) -> str | None:
    """None if equal, else a description of the first difference."""
    rows = [tuple(r) for r in spark_df.collect()]
    relation = connection.execute(sql)
    columns = [d[0] for d in relation.description]
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns differ: {sorted(spark_df.columns)} vs {sorted(columns)}"
    types = dict(spark_df.dtypes)
    for name, kind in ((d[0], str(d[1])) for d in relation.description):
        if types[name] == "int" and kind in ("BIGINT", "HUGEINT"):
            return f"{name}: int vs {kind}"
    expected = relation.fetchall()
    ours, theirs = bag(spark_df.columns, rows), bag(columns, expected)
    if ours != theirs:
        extra = list((ours - theirs).items())[:3]
        missing = list((theirs - ours).items())[:3]
        return f"rows {len(rows)} vs {len(expected)}\n only ours: {extra}\n only SQL: {missing}"
    return None
