"""Run catalog keys on Spark and their SQL on DuckDB; compare results.

Usage: python tests/oracle_compare.py [sf_dir] [key ...]
Mirrors the driver's check: same row count, same column names, and equal
values after sorting columns by name and rows by value.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT"}


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, round(v, 9))
    if isinstance(v, bool):
        return (3, int(v))
    if isinstance(v, int):
        return (2, float(v))
    return (4, str(v))


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(out)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    scols, s = rows_of(sdf.columns, srows)
    dcols2, d = rows_of(dcols, drows)
    stypes = {n: SPARK_TO_DUCK.get(t, t) for n, t in sdf.dtypes}
    dtypes = {c[0]: str(c[1]) for c in res.description}
    type_diff = {n: (stypes[n], dtypes.get(n)) for n in stypes if stypes[n] != dtypes.get(n)}
    ok = scols == dcols2 and s == d and not type_diff
    detail = ""
    if scols != dcols2:
        detail = f"columns {scols} vs {dcols2}"
    elif type_diff:
        detail = f"types {type_diff}"
    elif len(s) != len(d):
        detail = f"rows {len(s)} vs {len(d)}"
    elif s != d:
        diff = [(a, b) for a, b in zip(s, d) if a != b][:3]
        detail = f"first diffs {diff}"
    return ok, len(s), t1 - t0, detail


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    from regstat.session import get_session
    import __spark_entry__ as E
    if os.environ.get("PLAIN_SESSION"):
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]")
                 .config("spark.sql.shuffle.partitions", "8").getOrCreate())
    else:
        spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in sorted(qs):
        if wanted and name not in wanted:
            continue
        if name not in sqls:
            df = qs[name](spark, sf_dir)
            n = df.count()
            print(f"ROWS  {name:28s} rows={n} (no oracle)")
            continue
        try:
            ok, n, secs, detail = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as exc:  # report and continue
            ok, n, secs, detail = False, -1, 0.0, f"error {type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'}  {name:28s} rows={n} {secs:.2f}s {detail}")
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
