"""Compare a query's rows with its SQL run by DuckDB on the same tables."""

import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def assert_same(df, sf_dir, sql):
    found = duck(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    want = found.fetchall()
    columns = sorted(names)
    assert columns == sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in want)
