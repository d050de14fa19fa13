"""Rows of Spark and DuckDB as comparable values."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return str([plain(x) for x in v])
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def same(df, con, sql):
    cols = sorted(df.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    b = sorted((tuple(plain(dict(zip(names, x))[c]) for c in cols) for x in r.fetchall()), key=str)
    assert a == b
    return len(a)
