"""Run queries against their oracles: python -m checks.compare SF_DIR [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb

from checks.registry import ORACLES, QUERIES
from checks.tables import DerivedTables
from estilens.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


# Column types that must agree, as Spark and DuckDB name them.
SAME_TYPE = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def cell(value):
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare_rows(result, con, name):
    rows = [tuple(r) for r in result.collect()]
    left = normal(result.columns, rows)
    cursor = con.execute(ORACLES[name])
    found = cursor.fetchall()
    right = normal([d[0] for d in cursor.description], found)
    if left[0] != right[0]:
        return f"COLUMNS {sorted(set(left[0]) ^ set(right[0]))}", len(rows)
    types = dict(result.dtypes)
    odd = [(d[0], types[d[0]], str(d[1])) for d in cursor.description
           if SAME_TYPE.get(types[d[0]]) != str(d[1])]
    if odd:
        return f"TYPES {odd}", len(rows)
    if len(left[1]) != len(right[1]):
        return f"ROWS spark={len(left[1])} oracle={len(right[1])}", len(rows)
    if left[1] != right[1]:
        extra = sorted(set(left[1]) - set(right[1]))[:2]
        missing = sorted(set(right[1]) - set(left[1]))[:2]
        return f"VALUES {left[0]}\n  spark  {extra}\n  oracle {missing}", len(rows)
    if not rows:
        return "EMPTY", 0
    return "ok", len(rows)


def main(sf_dir: str, names: list[str]) -> int:
    spark = local_session()
    tables, con = DerivedTables(spark, sf_dir), database(sf_dir)
    bad = 0
    for name in names or list(QUERIES):
        start = time.perf_counter()
        try:
            status, count = compare_rows(QUERIES[name](tables), con, name)
        except Exception as error:  # report and go on with the next query
            status, count = f"ERROR {type(error).__name__} {str(error)[:1500]}", 0
        bad += status != "ok"
        print(f"{name:28s} {time.perf_counter() - start:6.2f}s {count:8d} {status}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
