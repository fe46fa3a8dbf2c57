"""Compares queries with their SQL, as the driver does: rows as sorted tuples, columns by name.

Run by hand over any scale:  python -m tests.compare /root/testdata/sf0.01 [NAME...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else float(f"{v:.14g}"))
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (datetime.date, datetime.timedelta)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def main(sf_dir: str, only: list[str]) -> int:
    import __spark_entry__ as e

    from tests.session import session

    spark, con, bad = session(), connect(sf_dir), 0
    sqls = e.oracle_sql()
    for name, f in e.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            got = rows_of_spark(f(spark, sf_dir))
            took = time.time() - t
            if name not in sqls:
                print(f"rows {name}: {len(got[1])} in {took:.1f} s", flush=True)
                continue
            want = rows_of_sql(con, sqls[name])
            same = got == want
            bad += not same
            print(f"{'ok  ' if same else 'BAD '} {name}: {len(got[1])} {len(want[1])} in {took:.1f} s", flush=True)
            if not same:
                print("  columns", got[0], want[0])
                print("  only spark", [r for r in got[1] if r not in set(want[1])][:3])
                print("  only sql  ", [r for r in want[1] if r not in set(got[1])][:3])
        except Exception as x:
            bad += 1
            print(f"FAIL {name}: {str(x)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
