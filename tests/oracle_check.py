"""Compares registered queries with their SQL; also a command: `python tests/oracle_check.py SF_DIR [name ...]`."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con




def differences(actual, con, sql: str) -> list[str]:
    """What differs between a Spark result and the SQL's, as texts; empty when they agree."""
    expected = con.sql(sql)
    names = sorted(expected.columns)
    if sorted(actual.columns) != names:
        return [f"columns {sorted(actual.columns)} but expected {names}"]
    # Fetched as plain Python values on both sides, as 9999-12-31 is beyond pandas' nanoseconds.
    left = sorted([tuple(str(row[c]) for c in names) for row in actual.collect()])
    order = [expected.columns.index(c) for c in names]
    right = sorted([tuple(str(row[i]) for i in order) for row in expected.fetchall()])
    if left == right:
        return []
    found = [f"rows {len(left)} but expected {len(right)}"]
    found += [f"only in Spark: {r}" for r in sorted(set(left) - set(right))[:3]]
    found += [f"only in SQL: {r}" for r in sorted(set(right) - set(left))[:3]]
    return found


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as contract
    from tests.conftest import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), oracle_connection(sf_dir)
    failed = 0
    for name, query in contract.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            found = differences(query(spark, sf_dir), con, contract.oracle_sql()[name])
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s", *found, sep="\n     ", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
