"""Run registered queries beside their SQL twins: ``python tests/oracle.py [prefix ...] [--sf DIR]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return "dec" + str(v)
    if isinstance(v, dict):
        return "{" + ",".join(sorted(f"{plain(k)}:{plain(x)}" for k, x in v.items())) + "}"
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, key, fn, sql):
    """None when equal, else what differs."""
    df = fn(spark, sf)
    got = df.collect()
    if sql is None:
        return None if got is not None else "no rows", len(got)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", len(got)
    g, w = rows_of(df.columns, got), rows_of(cols, want)
    if g == w:
        return None, len(g)
    gs, ws = set(g), set(w)
    more, less = [x for x in g if x not in ws][:3], [x for x in w if x not in gs][:3]
    return f"rows {len(g)} != {len(w)}; only here {[m[:300] for m in more]}; only there {[m[:300] for m in less]}", len(g)


def main():
    from spanloom.plans import load_all
    from spanloom.plans.registry import ORACLE, QUERIES
    from spanloom.session import local_session
    load_all()
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    spark = local_session()
    con = connect(sf)
    bad = 0
    for key, fn in QUERIES.items():
        if args and not any(key.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            diff, n = compare(spark, con, sf, key, fn, ORACLE.get(key))
        except Exception as x:  # a failing query is reported beside the others
            diff, n = f"{type(x).__name__}: {str(x)[:900]}", -1
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'BAD '} {'sql ' if key in ORACLE else 'rows'} {key:28s} n={n} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
