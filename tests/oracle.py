"""Runs a query and its SQL on the same tables and compares the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df, columns):
    return sorted((tuple(r[c] + 0.0 if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect()), key=repr)


def compare(spark, sf, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = query(spark, sf)
    columns = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] + 0.0 if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in columns) for r in cur.fetchall()), key=repr)
    got = rows_of(df, columns)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-4 + 1e-9 * abs(y) for x, y in zip(a, b, strict=True)), (a, b)
