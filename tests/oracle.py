"""Compares a query with its SQL over the smallest test tables."""

import datetime as dt
import decimal
import glob
import os

DATA = "/root/testdata/sf0.001"


def plain(x):
    if x is None:
        return "NULL"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        f = float(x)
        return "NULL" if f != f else str(int(x)) if f.is_integer() else f"{f:.6g}"
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def differences(spark, query, sql):
    """(columns of both, rows only in the query's result, rows only in the SQL's)."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = query(spark, DATA)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    order = [names.index(c) for c in cols] if sorted(names) == cols else None
    theirs = sorted(tuple(plain(row[i]) for i in order) for row in r.fetchall()) if order is not None else []
    held, wanted = set(mine), set(theirs)
    return (cols, sorted(names)), [x for x in mine if x not in wanted][:3] or (["count"] if len(mine) != len(theirs) else []), [x for x in theirs if x not in held][:3]
