"""Runs registered queries next to their SQL in DuckDB and compares the rows.

``python tests/compare.py <sf_dir> [name ...]``
"""

from __future__ import annotations

import math
import sys
import time
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else repr(round(float(value), 6))
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def kinds(columns: list[str], rows) -> dict[str, set[str]]:
    found: dict[str, set[str]] = {c: set() for c in columns}
    for row in rows:
        for c, v in zip(columns, row):
            if v is not None:
                found[c].add("int" if isinstance(v, int) and not isinstance(v, bool) else type(v).__name__)
    return found


def compare(spark, con, run, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = run(spark, sf_dir)
    got = df.collect()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if kinds(df.columns, got) != kinds(columns, expected):
        return f"types {kinds(df.columns, got)} against {kinds(columns, expected)}"
    left, right = rows_of(df.columns, got), rows_of(columns, expected)
    if left == right:
        return None if left else "both are empty"
    missing, extra = set(right) - set(left), set(left) - set(right)
    return f"{len(left)} rows against {len(right)}; only SQL {str(list(missing)[:2])[:700]}; only Spark {str(list(extra)[:2])[:700]}"


def main() -> int:
    import __spark_entry__ as entry

    from forumlake.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session("compare"), connect(sf_dir)
    queries, oracle, bad = entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        began = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, queries[name], oracle[name], sf_dir)
            else:
                problem = None if queries[name](spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - began:6.2f}s {'ok' if problem is None else 'DIFFERS ' + problem}", flush=True)
    print(f"{len(names or queries) - bad} equal, {bad} not")
    return bad


if __name__ == "__main__":
    sys.exit(main())
