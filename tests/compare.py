"""Order-insensitive comparison of a Spark result with its DuckDB SQL."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return f"{value:.10g}" if value != 0 else "0"
    if isinstance(value, int):
        return f"i{value}"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark_frame, connection, sql: str) -> str | None:
    """None when both give the same rows under the same column names."""
    left = bag(spark_frame.columns, [tuple(r) for r in spark_frame.collect()])
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    right = bag(names, cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} against {right[0]}"
    if left[1] == right[1]:
        return None
    only_left, only_right = left[1] - right[1], right[1] - left[1]
    return (
        f"{sum(left[1].values())} rows against {sum(right[1].values())}; "
        f"{sum(only_left.values())} differ, e.g. {list(only_left)[:2]} against {list(only_right)[:2]}"
    )
