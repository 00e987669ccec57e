"""Run a query and its SQL side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    engine = duckdb.connect()
    engine.execute("set timezone = 'UTC'")
    for file in Path(folder).glob("*.parquet"):
        engine.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return engine


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, list):
        return [plain(v) for v in value]
    value = float(value)
    return 0.0 if value == 0 else (round(value, 9) if math.isfinite(value) else value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(([plain(row[i]) for i in order] for row in rows), key=repr)


def spark_table(df):
    return table(df.columns, [tuple(row) for row in df.collect()])


def sql_table(engine, sql):
    result = engine.execute(sql)
    return table([d[0] for d in result.description], result.fetchall())
