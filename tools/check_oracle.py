"""Run registered queries and their SQL side by side and report differences.

Usage: python tools/check_oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from vitrine.plans import ORACLES, QUERIES
from vitrine.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(spark, con, sf: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, sf)
    table = df.toArrow()
    took = time.time() - start
    got_cols = sorted(table.column_names)
    got = table.select(got_cols)
    if name not in ORACLES:
        return len(got) > 0, f"rows only: {len(got)} rows, {took:.1f}s {got_cols}"
    start = time.time()
    want = con.sql(ORACLES[name]).to_arrow_table()
    sql_took = time.time() - start
    cols = sorted(want.column_names)
    info = f"{len(got)} rows, spark {took:.1f}s, sql {sql_took:.1f}s"
    if cols != got_cols:
        return False, f"columns {got_cols} != {cols}"
    want = want.select(cols)
    types = [
        f"{c}: {a} != {b}"
        for c, a, b in zip(cols, got.schema.types, want.schema.types)
        if str(a).replace("large_", "") != str(b).replace("large_", "")
    ]
    left = Counter(zip(*[got[c].to_pylist() for c in cols]))
    right = Counter(zip(*[want[c].to_pylist() for c in cols]))
    if left != right:
        a, b = list((left - right).items()), list((right - left).items())
        return False, f"{info}; rows {len(got)} vs {len(want)}, {len(a)} differ:\n   {sorted(a, key=str)[:3]}\n   {sorted(b, key=str)[:3]}"
    return not types, info + (f"; types {types}" if types else "")


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    names = [n for n in QUERIES if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    bad = 0
    for name in names:
        try:
            ok, info = compare(spark, con, args.sf, name)
        except Exception as e:  # noqa: BLE001
            ok, info = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, info, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
