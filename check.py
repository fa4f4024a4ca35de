"""Compare every registered query with its SQL oracle: check.py [sf_dir] [name …]."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}" if v != int(v) else str(int(v))
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=str), [cols[i] for i in order]


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()]) if sql is not None else ((df.collect()), df.columns)
    took = time.time() - t0
    if sql is None:
        return False, f"no oracle: {len(got)} rows", took
    cur = con.execute(sql)
    want, wcols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != wcols:
        return False, f"columns {cols} <> {wcols}", took
    if got != want:
        key = lambda rows: set(map(str, rows))
        only_g = sorted(key(got) - key(want))[:3]
        only_w = sorted(key(want) - key(got))[:3]
        return False, f"rows {len(got)} <> {len(want)}\n   spark  {only_g}\n   oracle {only_w}", took
    return True, f"{len(got)} rows", took


def main():
    import warnings

    warnings.filterwarnings("ignore")
    from courtside.plans import ORACLES, QUERIES
    from courtside.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or sorted(QUERIES)
    spark, con = local_session(8), oracle_connection(sf_dir)
    bad = 0
    for n in names:
        try:
            ok, msg, took = compare(spark, con, n, QUERIES[n], ORACLES.get(n), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, msg, took = False, f"{type(e).__name__}: {str(e)[:600]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n:32s} {took:6.2f}s {msg}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
