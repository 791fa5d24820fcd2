"""Compare registered queries with their DuckDB statements, like the driver does."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def check(spark, con, sf, name, fn, sql):
    t = time.time()
    df = fn(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    secs = time.time() - t
    if sql is None:
        return True, f"{name}: rows={len(rows)} {secs:.1f}s (no statement)"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    exp = bag(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} vs {sorted(cols)}"
    got = bag(df.columns, rows)
    a, b = got - exp, exp - got
    ok = not a and not b
    msg = f"{name}: rows={len(rows)} {secs:.1f}s {'ok' if ok else f'DIFF +{sum(a.values())} -{sum(b.values())}'}"
    if not ok:
        msg += f"\n   cols {sorted(cols)}\n   spark {list(a)[:2]}\n   duck  {list(b)[:2]}"
    return ok, msg


def main():
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from lodegrid.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    want = sys.argv[1:]
    spark, con = local_session(8), connect(sf)
    qs, ora, bad = e.queries(), e.oracle_sql(), []
    for n, fn in qs.items():
        if want and not any(w in n for w in want):
            continue
        try:
            ok, msg = check(spark, con, sf, n, fn, ora.get(n))
        except Exception as x:  # noqa: BLE001 - report and go on
            ok, msg = False, f"{n}: ERROR {str(x)[:700]}"
        print(msg if ok else "!! " + msg, flush=True)
        if not ok:
            bad.append(n)
    print("failed:", bad)


if __name__ == "__main__":
    main()
