"""Run registered queries on Spark and their SQL on DuckDB, and compare.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(0.0 if v == 0 else v)
    return str(v)


def kind(v) -> str:
    return type(v).__name__


def compare(name, spark_fn, sql, spark, sf_dir, con) -> str:
    t0 = time.time()
    df = spark_fn(spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(rows)} rows {t1 - t0:.1f}s"
    rel = con.execute(sql)
    ocols = [d[0] for d in rel.description]
    order = [ocols.index(c) for c in sorted(ocols)]
    orows = [tuple(r[i] for i in order) for r in rel.fetchall()]
    t2 = time.time()
    if sorted(ocols) != cols:
        return f"COLUMNS differ: spark {cols} sql {sorted(ocols)}"
    if len(rows) != len(orows):
        return f"ROWS differ: spark {len(rows)} sql {len(orows)}"
    a = sorted(tuple(map(cell, r)) for r in rows)
    b = sorted(tuple(map(cell, r)) for r in orows)
    for i, c in enumerate(cols):
        ka = {kind(r[i]) for r in rows if r[i] is not None}
        kb = {kind(r[i]) for r in orows if r[i] is not None}
        if ka != kb:
            return f"TYPES differ in {c}: spark {ka} sql {kb}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diff = [(c, p, q) for c, p, q in zip(cols, x, y) if p != q]
        return f"VALUES differ in {len(bad)} of {len(a)} rows, e.g. {diff[:4]} in {x[:6]}"
    empty = " EMPTY" if not rows else ""
    return f"ok {len(rows)} rows spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s{empty}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from tidewatch.session import build_session

    spark = build_session(master="local[8]", shuffle_partitions=8)
    con = connect(args.sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1]))
                                                         for a in args.names)]
    failed = 0
    t0 = time.time()
    for n in names:
        try:
            res = compare(n, queries[n], sqls.get(n), spark, args.sf, con)
        except Exception as exc:  # noqa: BLE001 - report and go on
            res = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        if not res.startswith(("ok", "rows-only")) or res.endswith("EMPTY"):
            failed += 1
        print(f"{n:32s} {res}", flush=True)
    print(f"{len(names)} queries, {failed} to look at, {time.time() - t0:.0f}s")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
