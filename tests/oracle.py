"""Run registered queries next to their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, Decimal)):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, folder):
    """None when equal, else a short description of the difference."""
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got != want:
        gs, ws = set(got), set(want)
        return f"rows {len(got)} vs {len(want)}; extra {[r for r in got if r not in ws][:3]}; missing {[r for r in want if r not in gs][:3]}"
    return None


def main():
    sys.path.insert(0, "/root/repo")
    from quillmesh.plans import ORACLES, QUERIES
    from quillmesh.session import local_session

    folder, names = sys.argv[1], sys.argv[2:] or sorted(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for n in names:
        t0 = time.time()
        try:
            if n in ORACLES:
                diff = compare(spark, con, n, QUERIES[n], ORACLES[n], folder)
            else:
                diff = None if QUERIES[n](spark, folder).count() >= 0 else "no rows"
        except Exception as e:
            lines = [x for x in str(e).splitlines() if x.strip()]
            diff = f"{type(e).__name__}: {' | '.join(lines[:3])[:600]}"
        bad += diff is not None
        if diff or "-q" not in names:
            print(f"{'ok  ' if diff is None else 'FAIL'} {n} {time.time() - t0:.2f}s {'' if n in ORACLES else '(rows only)'} {diff or ''}"[:1500], flush=True)
    print(f"{len(names)} queries, {bad} failing")


if __name__ == "__main__":
    main()
