"""Comparing a Spark result with DuckDB SQL on the same Parquet files."""

import math
from pathlib import Path

import duckdb


def duckdb_over(folder: str, parts: str = "") -> duckdb.DuckDBPyConnection:
    """A view per table; ``parts`` selects the files where a table is a folder of them."""
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{parts}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return sorted(df.columns), _sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def duckdb_rows(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return sorted(columns), _sorted_rows(columns, result.fetchall())
