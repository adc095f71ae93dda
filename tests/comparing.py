"""Comparing a query's rows with those of its SQL."""

from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(row):
    return tuple(repr(float(x)) if isinstance(x, (float, Decimal)) else str(x) for x in row)


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(norm(r) for r in df.select(*columns).collect())


def rows_of_sql(con, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(norm([r[i] for i in order]) for r in result.fetchall())
