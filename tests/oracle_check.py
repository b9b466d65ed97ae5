"""Run registered queries next to their SQL: ``python -m tests.oracle_check [names]``."""

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    lines = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(lines, key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    left = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = table([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} against {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows against {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            return f"{a} against {b}"
    return None


def main(names):
    from exposurelab.plans.queries import REGISTRY, Tables
    from exposurelab.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session("8"), connect(folder)
    bad = 0
    for name, (build, sql) in REGISTRY.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = build(Tables(spark, folder))
            if sql is None:
                rows = df.collect()
                problem, note = None, f"rows only: {len(rows)} {rows[:2]}"
            else:
                problem, note = compare(df, con, sql), ""
        except Exception as error:
            problem, note = f"{type(error).__name__}: {str(error)[:900]}", ""
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name:28s} {time.time() - start:6.2f}s {problem or note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
