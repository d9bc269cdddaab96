"""Compare registered queries with their SQL cross-check: python tests/oracle.py [names...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from quarrylens.plans.registry import TABLES  # noqa: E402

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connect(folder: str = SF_DIR):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if hasattr(value, "tolist"):
        return canonical(value.tolist())
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(canonical(r[c]) for c in cols) for r in df.collect())


def rows_of_sql(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in cur.fetchall())


def compare(spark, con, name: str, folder: str = SF_DIR):
    import __spark_entry__ as entry

    got = rows_of_spark(entry.queries()[name](spark, folder))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got[1])} rows (no SQL)"
    want = rows_of_sql(con, sql)
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return False, f"rows {len(got[1])} != {len(want[1])}; spark {got[1][:3]} sql {want[1][:3]}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got[1])} rows differ, e.g. {got[0]}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return True, f"{len(got[1])} rows equal"


def main(names):
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark = make_session()
    con = connect()
    failed = 0
    for name in names or entry.queries():
        start = time.time()
        try:
            ok, note = compare(spark, con, name)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
