"""Rows of a query and of its SQL, in one comparable form."""

import os
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def norm(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(sql, sf=SF):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in got.fetchall()), key=repr)
