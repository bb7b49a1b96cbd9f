"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

from __spark_entry__ import oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows_of(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def difference(spark, con, name: str, folder: str) -> str | None:
    """None if both engines agree, else what differs. A plan with a pairwise join or row-wise Python counts as a difference."""
    df = queries()[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "NestedLoop", "BatchEvalPython"):
        if node in plan:
            return f"{node} in its plan"
    mine = rows_of(df.columns, df.collect())
    sql = oracle_sql().get(name)
    if sql is None:
        return None if mine else "no rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if mine != theirs:
        left, right = sorted(set(mine) - set(theirs))[:3], sorted(set(theirs) - set(mine))[:3]
        return f"{len(mine)} rows against {len(theirs)}\n  columns {sorted(names)}\n  spark {left}\n  sql   {right}"
    return None if mine else "no rows"


if __name__ == "__main__":
    from wardwatch.session import local_session

    folder = "/root/testdata/sf0.01"
    session, con = local_session(8), connect(folder)
    failed = 0
    for name in sys.argv[1:] or list(queries()):
        start = time.time()
        try:
            found = difference(session, con, name, folder)
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {time.time() - start:6.2f}s {name} {found or ''}", flush=True)
    print("failed:", failed)
