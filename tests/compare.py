"""Compare a query's rows with those of its SQL."""

import math
import os

import duckdb
import numpy as np
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in sorted(os.listdir(folder)):
        p = os.path.join(folder, t)
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple, np.ndarray)) and not hasattr(v, "asDict"):
        return "[" + ",".join(str(plain(x)) for x in v) + "]"
    if v is pd.NaT:
        return None
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).tz_localize(None).isoformat()
    return v if v is None else str(v)


def rows_of(columns, rows):
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple("" if x is None else x for x in r))


def check(spark, con, query, sql, folder):
    df = query(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]
