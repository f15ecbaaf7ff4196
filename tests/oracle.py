"""Side-by-side check: Spark query against its SQL twin in DuckDB.

``python tests/oracle.py [--sf DIR] [name ...]``
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
_KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "SMALLINT": "smallint", "FLOAT": "float", "TIMESTAMP": "timestamp", "DATE": "date", "BLOB": "binary"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_canonical(r[i]) for i in order) for r in rows),
                  key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, con, name, run, sql, sf_dir):
    """(ok, text)"""
    started = time.time()
    df = run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    if sql is None:
        return True, f"{spent:6.1f}s rows={len(got)} (no SQL twin)"
    result = con.execute(sql)
    types = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchall()
    names_spark, names_sql = df.columns, list(types)
    if sorted(names_spark) != sorted(names_sql):
        return False, f"columns {sorted(names_spark)} != {sorted(names_sql)}"
    kinds = dict(df.dtypes)
    odd = {c: (kinds[c], types[c]) for c in names_spark if _KINDS.get(types[c], types[c]) != kinds[c]}
    a, b = _rows(names_spark, got), _rows(names_sql, want)
    if a != b:
        extra = [r for r in a if r not in set(b)][:2] if len(a) < 300000 else "?"
        missing = [r for r in b if r not in set(a)][:2] if len(b) < 300000 else "?"
        n_diff = sum(1 for x, y in zip(a, b) if x != y)
        return False, f"{sorted(names_spark)} rows {len(a)} vs {len(b)}, differing {n_diff}; only Spark {extra}; only SQL {missing}"
    if odd:
        return False, f"types {odd}"
    return True, f"{spent:6.1f}s rows={len(got)}"


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from reliefspark.session import build_session

    spark = build_session("oracle", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    bad = 0
    for name in names:
        try:
            ok, text = compare(spark, con, name, queries[name], oracles.get(name), args.sf)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, text = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:36s} {text}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)
