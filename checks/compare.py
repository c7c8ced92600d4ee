"""Run registered queries beside their SQL and report differences.

usage: python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

from colsight.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v: object) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        x = float(v)
        return repr(0.0 if x == 0 else x)
    if type(v).__name__ == "Decimal":
        return repr(float(v))
    return str(v)


def rows_of(pdf: pd.DataFrame) -> list[tuple[str, ...]]:
    cols = sorted(pdf.columns)
    return sorted(tuple(plain(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None))


def differences(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(sql_pdf.columns)}"
    a, b = rows_of(spark_pdf), rows_of(sql_pdf)
    if a == b:
        return None
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return f"rows {len(a)} vs {len(b)}; first differences {diff}"


def main() -> int:
    from checks.queries import QUERIES

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in args or QUERIES:
        fn, sql = QUERIES[name]
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            note = f"{len(got)} rows, no SQL" if sql is None else differences(got, con.execute(sql).df())
        except Exception as exc:  # noqa: BLE001 - report every query
            took, note = time.time() - start, f"ERROR {str(exc)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        ok = note is None or note.endswith("no SQL")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {took:6.2f}s {name} {note or ''}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
