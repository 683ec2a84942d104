"""Runs a query and its SQL and compares rows by sorted column."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def same(spark, folder, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    own = [d[0] for d in cur.description]
    assert sorted(own) == names
    want = sorted(tuple(shown(r[own.index(c)]) for c in names) for r in cur.fetchall())
    assert got == want
