"""Comparing a Spark result with DuckDB's, as multisets of rows."""

import glob
import os

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(x):  # noqa: ANN001, ANN202
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6) if x % 1 else int(x)
    return int(x) if isinstance(x, int) else str(x)


def rows(columns: list[str], data: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_cell(r[i]) for i in order]) for r in data)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:  # noqa: ANN001
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())
