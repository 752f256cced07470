"""Compare a Spark query with its SQL on the same tables: columns, rows, values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 9))
    return f"{value}"


def differences(spark_rows, spark_columns, con, sql: str) -> list[str]:
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    if sorted(columns) != sorted(spark_columns):
        return [f"columns {sorted(spark_columns)} vs {sorted(columns)}"]
    order = sorted(columns)
    theirs = sorted(tuple(_plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall())
    mine = sorted(tuple(_plain(r[c]) for c in order) for r in spark_rows)
    if mine == theirs:
        return []
    only_mine = sorted(set(mine) - set(theirs))[:3]
    only_theirs = sorted(set(theirs) - set(mine))[:3]
    return [f"{order}: {len(mine)} rows vs {len(theirs)}", f"spark only {only_mine}", f"sql only {only_theirs}"]
