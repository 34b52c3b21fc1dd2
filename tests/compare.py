"""Run registered queries next to their SQL counterpart and compare whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import time

import duckdb

SECONDS: dict[str, float] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, (int, float)):
        return "nan" if isinstance(value, float) and math.isnan(value) else round(float(value), 6)
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat().replace("T00:00:00", "")
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=lambda r: str(r)
    )


def differences(spark, connection, name, function, sql, folder):
    """None when both sides agree, else a short description."""
    start = time.time()
    frame = function(spark, folder)
    ours = rows_of(frame.columns, frame.collect())
    SECONDS[name] = time.time() - start
    cursor = connection.execute(sql)
    theirs = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"{name}: columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{name}: {len(ours[1])} rows != {len(theirs[1])}"
    for mine, other in zip(ours[1], theirs[1]):
        if mine != other:
            return f"{name}: {mine} != {other}"
    return None
