"""Run registered queries and compare them with their SQL on the same tables."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canon(rows, cols):
    at = sorted(range(len(cols)), key=lambda i: cols[i])

    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return "~"
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, (int, float)):
            return repr(float(v))
        return str(v)

    return [cols[i] for i in at], sorted(tuple(cell(r[i]) for i in at) for r in rows)


def compare(spark, con, name, fn, sql, folder):
    """None when equal, else a short description of the difference; and the two times."""
    s = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    spark_time = time.time() - s
    if sql is None:
        return None if got else "no rows", spark_time, 0.0, len(got)
    s = time.time()
    cur = con.execute(sql)
    want = cur.fetchall()
    duck_time = time.time() - s
    gc, g = canon(got, df.columns)
    wc, w = canon(want, [d[0] for d in cur.description])
    if gc != wc:
        return f"columns {gc} != {wc}", spark_time, duck_time, len(g)
    if len(g) != len(w):
        return f"rows {len(g)} != {len(w)}", spark_time, duck_time, len(g)
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        return f"{len(bad)} of {len(g)} differ: {str(bad[0])[:600]}", spark_time, duck_time, len(g)
    return None, spark_time, duck_time, len(g)


if __name__ == "__main__":
    import __spark_entry__ as E
    from peerlens.runtime import local_session

    folder = sys.argv[1]
    only = sys.argv[2:]
    spark = local_session(8)
    con = connect(folder)
    qs, os_ = E.queries(), E.oracle_sql()
    fails = 0
    for n, fn in qs.items():
        if only and not any(n.startswith(o) for o in only):
            continue
        try:
            diff, a, b, rows = compare(spark, con, n, fn, os_.get(n), folder)
        except Exception as e:
            diff, a, b, rows = f"ERROR {type(e).__name__} {str(e)[:700]}", 0, 0, 0
        fails += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {n:28s} rows={rows:7d} spark={a:6.2f}s sql={b:6.2f}s {'' if n in os_ else '(rows only)'} {diff or ''}", flush=True)
    print("failures:", fails, flush=True)
    os._exit(0)
