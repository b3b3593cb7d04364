"""Run registered queries beside their DuckDB twins: python tests/check_oracles.py SF_DIR [names]."""

from __future__ import annotations

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


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v + 0.0)
    return v if v is None else str(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    body = sorted(tuple(cell(r[i]) for i in order) for r in rows) if rows else []
    return [cols[i] for i in order], body


def key(rows):
    return sorted(rows, key=lambda r: tuple("" if x is None else x for x in r))


def compare(spark, con, folder, name, fn, oracle) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if oracle is None:
        return True, f"rows-only {len(rows)} rows {took:.1f}s"
    cur = con.execute(oracle)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    order = sorted(df.columns)
    a = key([tuple(cell(r[df.columns.index(c)]) for c in order) for r in rows])
    if sorted(dcols) != order:
        return False, f"columns differ: {order} / {sorted(dcols)}"
    b = key([tuple(cell(r[dcols.index(c)]) for c in order) for r in drows])
    if a == b:
        return True, f"{len(rows)} rows {took:.1f}s"
    only_a, only_b = sorted(set(a) - set(b), key=str), sorted(set(b) - set(a), key=str)
    return False, (
        f"{len(a)} / {len(b)} rows, columns {order}\n   spark : {only_a[:3]}\n   duckdb: {only_b[:3]}"
        f"\n   differing {len(only_a)} / {len(only_b)}"
    )


def main() -> None:
    from pyspark.sql import SparkSession

    from registry.queries import ORACLES, QUERIES

    from pitlake.plans.study import keep_landed

    keep_landed()
    folder = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = []
    for n in names:
        try:
            ok, note = compare(spark, con, folder, n, QUERIES[n], ORACLES.get(n))
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        print(("ok   " if ok else "FAIL ") + n + "  " + note, flush=True)
        if not ok:
            bad.append(n)
    print("failed:", bad)


if __name__ == "__main__":
    main()
