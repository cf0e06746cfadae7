"""Run a registered query and its SQL side by side; also a command line."""

import datetime
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, bytearray):
        return bytes(value)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


# Neither Python row by row nor joins that pair every row with every row.
FORBIDDEN = ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def compare(spark, con, folder, name, build, sql):
    started = time.time()
    df = build(spark, folder)
    found = [node for node in FORBIDDEN if node in plan(df)]
    if found:
        return 0.0, 0, f"plan has {found}"
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    if sql is None:
        return spent, sum(got.values()), None
    started = time.time()
    cur = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    problem = None
    if got_columns != want_columns:
        problem = f"columns {got_columns} != {want_columns}"
    elif got != want:
        extra, missing = list((got - want).items()), list((want - got).items())
        problem = (
            f"{sum(got.values())} rows, expected {sum(want.values())};"
            f" extra {len(extra)}: {str(extra[:2])[:700]}\n   missing {len(missing)}: {str(missing[:2])[:700]}"
        )
    return spent, sum(got.values()), problem


if __name__ == "__main__":
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = root
    import __spark_entry__ as entry
    from lorespark.session import local_session

    folder = sys.argv[1]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = sys.argv[2:] or list(queries)
    bad = 0
    for name in chosen:
        try:
            spent, n, problem = compare(spark, con, folder, name, queries[name], oracles.get(name))
        except Exception as e:  # noqa: BLE001
            spent, n, problem = 0, 0, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        state = "BAD " if problem else ("ok  " if name in oracles else "rows")
        print(f"{state} {name:24} {n:8} rows {spent:6.2f}s", problem or "", flush=True)
    print("problems:", bad)
