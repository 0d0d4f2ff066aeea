"""Run checked queries against their SQL twins: `python -m checks.compare [sf] [name-pattern]`."""

from __future__ import annotations

import re
import sys
import time

import duckdb

from clonespan.session import local_session

from .all_queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if hasattr(v, "as_tuple"):
        return repr(float(v))
    return repr(v)


def rows_of(pdf_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in pdf_rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if name not in ORACLES:
        return f"rows-only {len(got)} {t1 - t0:.2f}s"
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(cols) != sorted(df.columns):
        return f"FAIL columns {df.columns} vs {cols}"
    a, b = rows_of(got, df.columns), rows_of(want, cols)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"FAIL rows {len(a)} vs {len(b)} cols {sorted(cols)} {diff}"
    return f"ok {len(a)} rows, spark {t1 - t0:.2f}s, sql {t2 - t1:.2f}s"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    pattern = sys.argv[2] if len(sys.argv) > 2 else "."
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in QUERIES:
        if re.search(pattern, name):
            try:
                out = compare(spark, con, name, sf_dir)
            except Exception as e:  # report and go on with the next query
                out = f"ERROR {type(e).__name__} {str(e)[:900]}"
            bad += out.startswith(("FAIL", "ERROR"))
            print(f"{name}: {out}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
