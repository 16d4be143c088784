"""Run a named query on Spark and its check on DuckDB and compare whole results."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, con, name, build, sql, folder):
    """None when equal, else a short text."""
    df = build(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = rows([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}; only spark {sorted(set(got[1]) - set(want[1]))[:2]} only sql {sorted(set(want[1]) - set(got[1]))[:2]}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ, e.g. {bad[0]}"
    return None


def main(argv):
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as e
    from texelmill.session import local_session

    folder = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    checks, failed = e.oracle_sql(), 0
    for name, build in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            if name in checks:
                res = compare(spark, con, name, build, checks[name], folder)
                n = ""
            else:
                res, n = None, f"{build(spark, folder).count()} rows, no sql"
        except Exception as ex:  # noqa: BLE001
            res, n = f"{type(ex).__name__}: {str(ex)[:700]}", ""
        failed += res is not None
        print(f"{'ok  ' if res is None else 'FAIL'} {name} {time.time() - t0:.1f}s {res or n}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main(sys.argv)
