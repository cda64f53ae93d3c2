"""Compare a query with its SQL on the same tables."""

import glob
import math
import os

import duckdb


def connect(root):
    c = duckdb.connect()
    for p in glob.glob(f"{root}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def _plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())


def rows_of_sql(c, sql):
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    cols = sorted(names)
    at = [names.index(x) for x in cols]
    return cols, sorted(tuple(_plain(x[i]) for i in at) for x in r.fetchall())
