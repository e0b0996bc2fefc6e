"""Run registered queries and their DuckDB twins on one scale folder and report every difference.

usage: python tests/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from docskein.plans.fixtures import BASE_TABLES  # noqa: E402


def canonical(value):
    """Comparable text of one cell: floats to 6 digits, everything else by type."""
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}".replace("-0.000000", "0.000000")
    if isinstance(value, dict):
        return str(sorted((canonical(k), canonical(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return str([canonical(v) for v in value])
    return str(value)


def canonical_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark_df, con, sql):
    """None when equal, else a short description of the difference."""
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_types = {c[0]: str(c[1]) for c in cur.description}
    want_rows = cur.fetchall()
    got = [tuple(r) for r in spark_df.collect()]
    if sorted(spark_df.columns) != sorted(d_cols):
        return f"columns {sorted(spark_df.columns)} vs {sorted(d_cols)}"
    spark_types = dict(spark_df.dtypes)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{c}:{spark_types[c]}/{d_types[c]}" for c in d_cols
           if kinds.get(spark_types[c], spark_types[c]) != d_types[c]]
    a, b = canonical_rows(spark_df.columns, got), canonical_rows(d_cols, want_rows)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ, first: {str(bad[0][0])[:600]} | {str(bad[0][1])[:600]}"
    if odd:
        return "types " + ", ".join(odd)
    if not a:
        return "EMPTY"
    return None


def main():
    from __spark_entry__ import oracle_sql, queries
    from docskein.session import build_session

    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = build_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, sqls = queries(), oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                df = fn(spark, sf_dir)
                problem = compare(df, con, sqls[name])
            else:
                n = fn(spark, sf_dir).count()
                problem = None
                print(f"rows-only {name} {n} {time.time() - t0:.1f}s", flush=True)
                continue
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - t0:.1f}s {problem or ''}", flush=True)
    print(f"{failed} bad")


if __name__ == "__main__":
    main()
