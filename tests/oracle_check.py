"""Runs registered queries on Spark and their text on DuckDB and compares the rows.

    python tests/oracle_check.py [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.8f}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return str(value)
    return str(value)


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark, con, folder: str, query, text: str) -> tuple[list[str], int]:
    frame = query(spark, folder)
    found = [tuple(r) for r in frame.collect()]
    result = con.execute(text)
    wanted = result.fetchall()
    names = [d[0] for d in result.description]
    problems = []
    if sorted(names) != sorted(frame.columns):
        problems.append(f"columns {sorted(frame.columns)} != {sorted(names)}")
        return problems, len(found)
    left, right = _rows(frame.columns, found), _rows(names, wanted)
    if len(left) != len(right):
        problems.append(f"{len(left)} rows != {len(right)}")
    if left != right:
        a, b = set(left) - set(right), set(right) - set(left)
        problems.append(f"only Spark {len(a)}: {sorted(a)[:2]}; only DuckDB {len(b)}: {sorted(b)[:2]}")
    return problems, len(found)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from storelens.session import single_machine_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = single_machine_session(), connect(folder)
    texts, bad = oracle_sql(), 0
    for name, query in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            problems, rows = differences(spark, con, folder, query, texts[name])
        except Exception as error:  # report and go on with the next query
            problems, rows = [f"{type(error).__name__}: {str(error)[:600]}"], -1
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} rows={rows} {time.time() - began:.1f}s", flush=True)
        for problem in problems:
            print("    ", problem[:1200])
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
