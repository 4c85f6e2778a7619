"""A query's rows against those of its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(shown(r[c]) for c in names) for r in df.collect())


def sql_rows(sql, sf=SF, views=None):
    con = duckdb.connect()
    for t in TABLES:
        if views and t in views:
            con.register(t, views[t])
        elif os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(shown(x[i]) for i in order) for x in r.fetchall())
