"""Run registered queries against their oracle SQL.

Usage: python tests/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return repr(v)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, otherwise a description of the first difference."""
    df = query(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if mine else "no rows"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    a, b = canonical(mine, df.columns), canonical(theirs, columns)
    if a == b:
        return None if a else "EMPTY on both sides"
    only_a, only_b = set(a) - set(b), set(b) - set(a)
    return (f"{len(a)} vs {len(b)} rows; columns {sorted(columns)}\n"
            f"      spark only: {sorted(only_a)[:3]}\n      oracle only: {sorted(only_b)[:3]}")


def main() -> int:
    import __spark_entry__ as entry
    from evidentry.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if args[1:] and not any(name.startswith(p) for p in args[1:]):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, query, oracle.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        kind = "sql " if name in oracle else "rows"
        print(f"{'ok  ' if problem is None else 'BAD '} {kind} {name} {time.time() - start:.1f}s"
              + (f"\n      {problem}" if problem else ""), flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
