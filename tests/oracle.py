"""Side-by-side comparison of a query with its DuckDB SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(sql, sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, [dict(zip(names, r)) for r in cur.fetchall()]


def differences(df, sql, sf_dir):
    """Empty if the query and the SQL give the same columns and rows; else what differs."""
    names, want = rows_of(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    mine = sorted(repr([plain(r.asDict(True)[c]) for c in order]) for r in df.collect())
    theirs = sorted(repr([plain(r[c]) for c in order]) for r in want)
    if mine != theirs:
        a, b = [x for x in mine if x not in set(theirs)], [x for x in theirs if x not in set(mine)]
        return f"{len(mine)} and {len(theirs)} rows; only here: {a[:2]}; only there: {b[:2]}"
    return ""
