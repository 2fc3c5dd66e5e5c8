"""Comparison of a query with its SQL in DuckDB."""

import os

import duckdb


def connect(directory):
    c = duckdb.connect()
    for p in sorted(os.listdir(directory)):
        if p.endswith(".parquet"):
            c.execute(f"CREATE VIEW {p[:-8]} AS SELECT * FROM '{directory}/{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)


def expected(c, sql):
    result = c.execute(sql)
    names = [x[0] for x in result.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted((tuple(norm(r[i]) for i in order) for r in result.fetchall()), key=repr)
