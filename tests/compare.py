"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

usage: python tests/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as contract  # noqa: E402
from tabloom.session import local_session  # noqa: E402
from tabloom.sources.tables import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canon(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0) if value != int(value) or abs(value) > 1e15 else repr(float(int(value)))
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name):
    started = time.time()
    df = contract.queries()[name](spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    elapsed = time.time() - started
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(got)}", elapsed, bool(got)
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", elapsed, False
    if got != want:
        only_got = sorted(set(got) - set(want))[:3]
        only_want = sorted(set(want) - set(got))[:3]
        return f"rows {len(got)} vs {len(want)}\n   spark {only_got}\n   sql   {only_want}", elapsed, False
    return f"ok {len(got)}", elapsed, len(got) > 0


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = connect(sf_dir)
    bad = []
    for name in contract.queries():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        try:
            message, elapsed, fine = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            message, elapsed, fine = f"ERROR {str(error)[:1500]}", 0.0, False
        if not fine:
            bad.append(name)
        print(f"{'  ' if fine else '!!'} {name:32s} {elapsed:6.2f}s {message}", flush=True)
    print("FAILED", len(bad), bad)


if __name__ == "__main__":
    main(sys.argv[1:])
