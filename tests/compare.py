"""Compares a Spark result with the DuckDB result of its SQL: columns, row count and every value."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "\0null"
    return repr(value) if isinstance(value, float) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_cell(r[i]) for i in order) for r in rows])


def differences(spark_df, con, sql) -> str | None:
    columns = spark_df.columns
    mine = rows_of(columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    theirs_columns = [c[0] for c in cursor.description]
    theirs = rows_of(theirs_columns, cursor.fetchall())
    if sorted(columns) != sorted(theirs_columns):
        return f"columns {sorted(columns)} != {sorted(theirs_columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, columns {sorted(columns)}: {bad[0][0]} != {bad[0][1]}"
    return None
