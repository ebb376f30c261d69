"""Run registered queries next to their oracle SQL and compare rows.

    python -m tests.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = os.environ.get("SEGPANEL_TESTDATA", "/root/testdata")


def oracle_connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for path in glob.glob(f"{TESTDATA}/sf{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return datetime.datetime(value.year, value.month, value.day).isoformat()
    return value


def _key(row):
    return tuple((v is None, type(v).__name__ if not isinstance(v, (int, float)) else "n", str(v) if v is not None else "") for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=_key)


# Spark type -> oracle type; anything else is compared by name.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def type_differences(spark_df, con, sql) -> list[str]:
    """Columns whose declared types do not correspond; needs no execution."""
    theirs = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [f"{c}: {kind} / {theirs.get(c)}" for c, kind in spark_df.dtypes if TYPES.get(kind, kind) != theirs.get(c)]


def differences(spark_df, con, sql) -> tuple[str | None, int]:
    cols_a, a = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    cols_b, b = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols_a != cols_b:
        return f"columns {sorted(set(cols_a) ^ set(cols_b))}", len(a)
    if len(a) != len(b):
        return f"rows {len(a)} against {len(b)}", len(a)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    kinds = {c for x, y in zip(a, b) for c, u, v in zip(cols_a, x, y)
             if u is not None and v is not None and type(u) is not type(v)}
    if kinds:
        return f"types differ in {sorted(kinds)}: {a[0]} {b[0]}", len(a)
    if bad:
        x, y = bad[0]
        return f"{len(bad)} rows differ, first: " + ", ".join(f"{c}: {u!r} / {v!r}" for c, u, v in zip(cols_a, x, y) if u != v), len(a)
    return None, len(a)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--skip", type=int, default=0)
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from segpanel.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(args.sf)
    oracle, failed = entry.oracle_sql(), []
    names = args.names or list(entry.queries())[args.skip:]
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, f"{TESTDATA}/sf{args.sf}")
            if name in oracle:
                problem, n = differences(df, con, oracle[name])
                kinds = type_differences(df, con, oracle[name])
                problem = problem or (f"types: {kinds}" if kinds else None)
            else:
                problem, n = None, len(df.collect())
            text = df._jdf.queryExecution().executedPlan().toString()
            if "CartesianProduct" in text or "BroadcastNestedLoopJoin" in text:
                problem = problem or "the plan has a nested loop join"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, n = f"{type(error).__name__}: {str(error)[:700]}", -1
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={n} {time.time() - start:.1f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
