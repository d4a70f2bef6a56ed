"""Run queries on Spark and their SQL twins on DuckDB and compare the results.

Usage: python tests/compare.py [-d DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(table, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, con, name, query, sql, sf):
    """'' when equal, else the first difference."""
    df = query(spark, sf)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        bad = [c for i, c in enumerate(got_cols) if any(r[i] == "nan" for r in got)]
        return f"NaN in {bad}" if bad else ("" if got else "no rows")
    rel = con.execute(sql)
    want_cols, want = _rows([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    off = [(g, w) for g, w in zip(got, want) if g != w]
    for g, w in off:
        for c, a, b in zip(got_cols, g, w):
            if type(a) is not type(b):
                return f"{len(off)} rows, {c}: type {a!r} vs {b!r} in {g} {w}"
    if off:
        return f"{len(off)} of {len(got)} rows differ: {off[0][0]} vs {off[0][1]}"
    return "" if got else "no rows"


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("-d", default="/root/testdata/sf0.01")
    parser.add_argument("-p", default="", help="comma separated name prefixes")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from tickloom.plans.catalog import ORACLE, QUERIES
    from tickloom.session import local_session

    spark, con = local_session(cpus=8), connect(args.d)
    names = args.names or [n for n in QUERIES if not args.p or n.startswith(tuple(args.p.split(",")))]
    failed = []
    for n in names:
        t = time.time()
        try:
            problem = compare(spark, con, n, QUERIES[n], ORACLE.get(n), args.d)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        kind = "sql " if n in ORACLE else "rows"
        print(f"{'ok  ' if not problem else 'FAIL'} {kind} {time.time() - t:6.2f}s {n} {problem}", flush=True)
        if problem:
            failed.append(n)
    print(len(names), "queries,", len(failed), "failed", failed)
    spark.stop()


if __name__ == "__main__":
    main()
