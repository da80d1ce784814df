"""Compare registered queries with their SQL: ``python -m tests.oracle_check [sf_dir] [names]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DUCK_TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "DOUBLE": "double",
}


def duck(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def _normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_cell(row[i]) for i in order) for row in rows),
        key=lambda row: [(v is None, str(v)) for v in row],
    )


def compare(spark, connection, sf_dir: str, name: str) -> str | None:
    """A description of the difference, or None."""
    df = contract.queries()[name](spark, sf_dir)
    spark_rows = df.collect()
    cursor = connection.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    types = {d[0]: DUCK_TYPES.get(str(d[1]), str(d[1])) for d in cursor.description}
    rows = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    differing = {c: (t, types[c]) for c, t in df.dtypes if t != types[c]}
    if differing:
        return f"types {differing}"
    ours, theirs = _normal(df.columns, spark_rows), _normal(names, rows)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"row {a!r:.1500}\n  vs {b!r:.1500}"
    return None


def main(argv: list[str]) -> int:
    from tests.conftest import make_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, connection, bad = make_session(), duck(sf_dir), 0
    for name in argv[1:] or contract.queries():
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        rows = len(connection.execute(contract.oracle_sql()[name]).fetchall()) if not problem else 0
        print(f"{'ok ' if problem is None else 'BAD'} {name} {rows} {time.time() - start:.1f}s"
              + (f"\n  {problem}" if problem else ""), flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
