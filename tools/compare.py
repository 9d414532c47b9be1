"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows.

usage: python tools/compare.py <data folder> [name ...]
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import checks  # noqa: E402
from epicell.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(value) -> str:
    if value is None or value != value:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value)
    return str(value)


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(row[i]) for i in order) for row in rows)


def main() -> int:
    folder, names = sys.argv[1].rstrip("/"), sys.argv[2:]
    checks.load()
    spark = local_session("compare", cores="8")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = []
    for name in names or list(checks.QUERIES):
        start = time.time()
        try:
            df = checks.QUERIES[name](spark, folder)
            got = rows_of(df.columns, df.collect())
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name}: {str(e)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if name not in checks.ORACLES:
            print(f"rows  {name}: {sum(got.values())} rows, {took:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            cur = con.execute(checks.ORACLES[name])
            columns = [d[0] for d in cur.description]
            want = rows_of(columns, cur.fetchall())
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name} oracle: {str(e)[:1500]}", flush=True)
            continue
        sql_took = time.time() - start
        if sorted(columns) != sorted(df.columns):
            bad.append(name)
            print(f"DIFF  {name}: columns {sorted(set(df.columns) ^ set(columns))}", flush=True)
        elif got != want:
            bad.append(name)
            print(f"DIFF  {name}: {sum(got.values())} rows, wanted {sum(want.values())}", flush=True)
            print("   columns ", sorted(columns))
            for row in sorted((got - want))[:3]:
                print("   got     ", row)
            for row in sorted((want - got))[:3]:
                print("   wanted  ", row, flush=True)
        else:
            print(f"same  {name}: {sum(got.values())} rows, {took:.1f}s, sql {sql_took:.1f}s", flush=True)
    print("bad:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
