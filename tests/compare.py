"""Run registered queries against their SQL in DuckDB and compare values."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{root}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, root):
    """Returns (ok, message)."""
    start = time.time()
    df = query(spark, root)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return len(got) > 0, f"rows-only n={len(got)} {took:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    took_sql = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = normal_rows(df.columns, got), normal_rows(columns, want)
    if a != b:
        in_a, in_b = set(map(repr, a)), set(map(repr, b))
        only_a, only_b = [r for r in a if repr(r) not in in_b][:2], [r for r in b if repr(r) not in in_a][:2]
        return False, f"rows {len(a)} vs {len(b)}; spark only {str(only_a)[:300]}; sql only {str(only_b)[:300]}"
    return len(a) > 0, f"n={len(a)} spark {took:.1f}s sql {took_sql:.1f}s"


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tests.session import local_session

    root = argv[0]
    wanted = argv[1:]
    spark = local_session()
    con = connect(root)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, message = compare(spark, con, name, fn, oracles.get(name), root)
        except Exception as error:  # report and go on with the others
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {message}", flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
