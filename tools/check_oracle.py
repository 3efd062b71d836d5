"""Run registered queries next to their SQL twins in DuckDB and compare every value.

    python tools/check_oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallywork.catalog import QUERIES  # noqa: E402
from tallywork.catalog.registry import TABLE_NAMES  # noqa: E402
from tallywork.session import build_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    """Columns and rows by name, rows sorted, as comparable values with their types."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple((type(row[i]).__name__, repr(row[i] + 0.0 if isinstance(row[i], float) else row[i])) for i in order)
             for row in rows]
    return [columns[i] for i in order], sorted(plain)


def differences(spark_df, con, sql: str) -> str | None:
    """None if both give the same columns, rows, values and types, otherwise what differs."""
    got = table(spark_df.columns, spark_df.collect())
    cursor = con.execute(sql)
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    wrong = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(got[1])} rows differ, first:\n    {wrong[0][0]}\n    {wrong[0][1]}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in args.names or QUERIES:
        q, start = QUERIES[name], time.time()
        try:
            if q.sql is None:
                problem = None if q(spark, folder).count() else "no rows"
            else:
                problem = differences(q(spark, folder), con, q.sql)
        except Exception as error:  # noqa: BLE001  (report and go on)
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name}"
              + (f": {problem}" if problem else ""), flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
