"""Runs a query and its SQL on the same tables and compares the rows."""

import glob
import math
import os
from collections import Counter

import duckdb


def database(d):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(d + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else str(v) if not isinstance(v, (int, bool)) else v


def same(df, db, sql):
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    out = db.execute(sql)
    names = [x[0] for x in out.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
