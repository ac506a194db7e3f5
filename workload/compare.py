"""Run each query on Spark and its SQL on DuckDB and compare names, types and rows in any order.

    python -m workload.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

SPARK_TO_SQL = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(df, con, sql: str) -> str:
    """Empty text if both sides agree, else what differs."""
    names = sorted(df.columns)
    result = con.execute(sql)
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(types) != names:
        return f"columns {names} against {sorted(types)}"
    kinds = {f.name: SPARK_TO_SQL.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    differing = {n: (kinds[n], types[n]) for n in names if kinds[n] != types[n]}
    order = [list(types).index(n) for n in names]
    right = Counter(tuple(r[i] for i in order) for r in result.fetchall())
    left = Counter(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    if left != right:
        gone, extra = list((right - left).items())[:3], list((left - right).items())[:3]
        return f"{sum(left.values())} rows against {sum(right.values())}\n  only SQL {gone}\n  only Spark {extra}"
    return f"types {differing}" if differing else ""


def main() -> int:
    from fleetframe.session import build
    from workload.oracles import ORACLES
    from workload.queries import QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            problem = compare(df, con, ORACLES[name]) if name in ORACLES else f"no SQL; {df.count()} rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{'ok ' if not problem else 'BAD'} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{bad} of {len(QUERIES)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
