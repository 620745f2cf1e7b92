"""Compare registered queries with their check SQL: ``python -m tests.oracle [name-prefix ...] [--sf DIR]``."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

from fleetlens.plans import registry
from fleetlens.plans.standins import BASE

DATA = "/root/testdata"


def connect(folder: str):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return (2, "nan") if math.isnan(f) else (2, repr(f + 0.0))
    if isinstance(v, dt.datetime):
        return (3, v.replace(tzinfo=None).isoformat())
    return (4, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(cell(r[i]) for i in order) for r in rows])


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    df = registry.queries()[name](spark, folder)
    start = time.time()
    got_rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    sql = registry.checks().get(name)
    if sql is None:
        return True, f"rows only: {len(got_rows)}"
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return False, f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    got, want = rows_of(df.columns, got_rows), rows_of(want_cols, want_rows)
    if got == want:
        return True, f"{len(got)} rows, collect {took:.1f}s"
    extra, missing = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
    return False, f"rows {len(got)}/{len(want)}; only spark {extra}; only check {missing}"


def main(args: list[str]) -> int:
    from fleetlens.session import build_session

    folder = f"{DATA}/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        folder = args[i + 1]
        args = args[:i] + args[i + 2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
                          spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    bad = 0
    for name in registry.queries():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, name, folder)
        except Exception as problem:
            ok, note = False, f"{type(problem).__name__}: {str(problem)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - start:6.1f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
