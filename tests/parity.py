"""Comparing a query with its SQL, rows as sets of values by column name."""

import glob
import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def compare(spark, con, query, sql):
    df = query(spark, DATA)
    cols = sorted(df.columns)
    ours = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in cols]
    theirs = sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())
    assert sorted(names) == cols
    assert ours == theirs
