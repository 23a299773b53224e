"""Comparison of a query with its SQL on DuckDB."""

from decimal import Decimal
from pathlib import Path

import duckdb


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, (float, Decimal)):
        return repr(round(float(v), 6) + 0.0)
    return repr(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())


def duck_rows(sql, tables):
    con = duckdb.connect()
    for name, source in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'") if isinstance(source, str) else con.register(name, source)
    r = con.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(c) for c in cols]
    return cols, sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())


def tables_of(sf):
    return {p.stem: str(p) for p in Path(sf).glob("*.parquet")}
