"""Compare registered queries with their SQL on DuckDB.

    python tests/check_queries.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}".replace("-0.000000", "0.000000")
    if v is None:
        return "\x00"
    if type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, con, sf_dir, fn, sql):
    """Returns (problem or None, row count)."""
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return None, len(rows)
    con.execute(sql)
    names = [d[0] for d in con.description]
    kinds = {d[0]: str(d[1]) for d in con.description}
    want = con.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(rows)
    types = [f"{c} {t} != {kinds[c]}" for c, t in df.dtypes if KINDS.get(t, kinds[c]) != kinds[c]]
    mine, theirs = canonical(df.columns, rows), canonical(names, want)
    if mine != theirs:
        a, b = [r for r in mine if r not in set(theirs)][:3], [r for r in theirs if r not in set(mine)][:3]
        return f"rows {len(mine)} != {len(theirs)}; spark {str(a)[:700]}; sql {str(b)[:700]}", len(rows)
    return (f"types: {types}" if types else None), len(rows)


def main():
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("names", nargs="*")
    args = p.parse_args()
    import __spark_entry__ as entry
    from quarry.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = connect(sf_dir)
    oracle, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        t0 = time.time()
        try:
            problem, n = compare(spark, con, sf_dir, fn, oracle.get(name))
        except Exception as e:  # noqa: BLE001
            text = str(e) if args.names else str(e)[:600]
            problem, n = f"{type(e).__name__}: {text[:3000]} {traceback.format_exc()[-300:] if args.names else ''}", 0
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} rows={n} {time.time() - t0:.1f}s{' (no sql)' if name not in oracle else ''} {problem or ''}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
