"""Compares a query's rows with those of its SQL in DuckDB."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def database(folder: str = SMALL):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in Path(folder).iterdir():
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{source}'")
    return con


def _value(v):
    if isinstance(v, Decimal):
        return str(v.to_integral_value()) if v == v.to_integral_value() else str(v)
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return None if v is None else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=str)


def compare(spark, con, query, sql, folder: str = SMALL) -> None:
    df = query(spark, folder)
    mine = rows_of(df.columns, df.collect())
    found = con.sql(sql)
    theirs = rows_of(found.columns, found.fetchall())
    assert sorted(df.columns) == sorted(found.columns)
    assert mine == theirs
