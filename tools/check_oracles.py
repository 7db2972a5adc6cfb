"""Run every registered query in Spark and its oracle SQL in DuckDB; compare results.

Usage: python tools/check_oracles.py [sf_dir] [key ...]
Compares column names, row counts and the multiset of rows (order-insensitive).
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.plans.catalog import ORACLE, QUERIES  # noqa: E402
from quire.session import build_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if isinstance(v, float):
        return ("f", None) if math.isnan(v) else ("f", round(v, 9))
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if v is None:
        return ("n", "")
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    return (type(v).__name__, str(v))


def main():
    args = sys.argv[1:]
    root = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    keys = [a for a in args if a != root] or sorted(QUERIES)
    spark = build_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            df = QUERIES[k](spark, root)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {k}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in ORACLE:
            print(f"ROWS  {k}: {len(s_rows)} rows (no oracle) {ts:.2f}s")
            continue
        try:
            rel = con.execute(ORACLE[k])
            d_cols = [c[0] for c in rel.description]
            d_rows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {k}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(s_cols) != sorted(d_cols):
            print(f"FAIL  {k}: columns {s_cols} vs {d_cols}")
            bad += 1
            continue
        order = [d_cols.index(c) for c in s_cols]
        d_rows = [tuple(r[i] for i in order) for r in d_rows]
        sa = sorted(tuple(norm(v) for v in r) for r in s_rows)
        sb = sorted(tuple(norm(v) for v in r) for r in d_rows)
        if sa != sb:
            bad += 1
            diff_a = [r for r in sa if r not in set(sb)][:3]
            diff_b = [r for r in sb if r not in set(sa)][:3]
            print(f"FAIL  {k}: {len(sa)} vs {len(sb)} rows; spark-only {str(diff_a)[:600]} duck-only {str(diff_b)[:600]}")
            continue
        print(f"OK    {k}: {len(sa)} rows {ts:.2f}s")
    print(f"{bad} failing of {len(keys)}")
    spark.stop()


if __name__ == "__main__":
    main()
