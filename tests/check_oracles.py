"""Compares every query with its SQL: ``python tests/check_oracles.py FOLDER [QUERY ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

SPARK_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def rows_of(records: list, names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in records), key=repr)


def compare(spark, folder: str, query, sql: str | None) -> str:
    df = query(spark, folder)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return f"rows only ({len(got)})"
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want = rows_of(result.fetchall(), names)
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
    for name, kind in df.dtypes:
        if SPARK_TYPES.get(kind) != types.get(name):
            problems.append(f"type {name}: {kind} vs {types.get(name)}")
    if len(got) != len(want):
        problems.append(f"{len(got)} rows vs {len(want)}")
    missing, extra = set(want) - set(got), set(got) - set(want)
    if missing or extra or got != want:
        problems.append(f"{len(missing)} missing, {len(extra)} extra: {str(sorted(missing, key=repr)[:1])[:500]} / {str(sorted(extra, key=repr)[:1])[:500]}")
    return "; ".join(problems) or f"equal ({len(got)})"


def main() -> None:
    import __spark_entry__ as entry
    from quire.session import local_session

    spark = local_session(8)
    folder, only = sys.argv[1], sys.argv[2:]
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            verdict = compare(spark, folder, query, sqls.get(name))
        except Exception as error:  # shown per query so that one failure hides no other
            verdict = f"ERROR {str(error)[:1200]}"
        print(f"{name}: {verdict} [{time.time() - start:.1f}s]", flush=True)


if __name__ == "__main__":
    main()
