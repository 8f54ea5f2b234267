"""Compare registered queries with their DuckDB oracle on the same parquet tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from tabularium.plans import REGISTRY
from tabularium.sources.tables import TABLE_NAMES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    """One comparable form for a value coming from Spark or DuckDB."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value.is_integer() else value)
    if isinstance(value, (dt.datetime, dt.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    query = REGISTRY[name]
    begun = time.time()
    frame = query.run(spark, folder)
    collected = frame.collect()
    took = f"{time.time() - begun:.2f}s spark"
    got = rows_of(frame.columns, [tuple(r) for r in collected])
    if query.sql is None:
        return True, f"rows={len(got)} (no SQL) {took}"
    result = con.execute(query.sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} != {sorted(names)}"
    if got != want:
        only_got = [r for r in got if r not in want][:3] if len(got) < 5000 else "..."
        only_want = [r for r in want if r not in got][:3] if len(want) < 5000 else "..."
        if only_got == "...":
            pair = next(((g, w) for g, w in zip(got, want) if g != w), None)
            only_got, only_want = pair or ("", "")
        return False, f"rows {len(got)} != {len(want)}\n   spark: {only_got}\n   sql:   {only_want}"
    return True, f"rows={len(got)} {took}"


if __name__ == "__main__":
    from tabularium.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in REGISTRY:
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, name, folder)
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - start:6.2f}s {name}: {note}", flush=True)
    print("failures:", bad)
