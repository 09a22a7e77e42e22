"""Hold a query's rows against DuckDB's rows for its oracle SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "__float__") and not isinstance(v, (bool, int, str)):
        return round(float(v), 9)
    return v


def same_rows(df, sql, folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted([tuple(_plain(v) for v in r) for r in cur.fetchall()], key=repr)
    got = sorted([tuple(_plain(r[c]) for c in names) for r in df.collect()], key=repr)
    assert got == want
