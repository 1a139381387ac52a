"""Compare registered queries with their DuckDB SQL: tools/check.py [sf] [name prefix ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rasterlake.catalog import all_queries  # noqa: E402
from rasterlake.catalog.compare import compare  # noqa: E402
from rasterlake.catalog.tables import BASE  # noqa: E402
from rasterlake.session import local_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    prefixes = tuple(sys.argv[2:]) or ("",)
    folder = f"/root/testdata/sf{sf}"
    reg = all_queries()
    spark = local_session(8)
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in BASE:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    bad = 0
    for name, build in reg.QUERIES.items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            got = build(spark, folder).toPandas()
            took = time.time() - start
            if name in reg.ORACLES:
                start = time.time()
                want = con.execute(reg.ORACLES[name]).df()
                problem = compare(got, want)
                duck = time.time() - start
                if not problem and not len(want):
                    problem = "EMPTY on both sides"
            else:
                problem, duck = ("" if len(got) else "EMPTY"), -1.0
        except Exception as err:  # noqa: BLE001 - report and go on
            problem, took, duck = f"{type(err).__name__}: {str(err)[:700]}", time.time() - start, -1.0
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:38s} {took:6.2f}s duck {duck:5.2f}s rows {len(got) if 'got' in dir() else '?'} {problem}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
