"""Compare registered queries with their SQL: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and a DuckDB result; empty when they agree exactly."""
    result = con.execute(sql)
    sql_names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(df.columns) != sorted(sql_names):
        return [f"columns {sorted(df.columns)} != {sorted(sql_names)}"]
    problems = []
    sql_types = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != sql_types[name]:
            problems.append(f"type of {name}: {kind} != {sql_types[name]}")
    got, want = _rows(df.collect(), df.columns), _rows(expected, sql_names)
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ, first {bad[0]}")
    if not want:
        problems.append("empty result")
    return problems


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    from __spark_entry__ import oracle_sql, queries
    from cohortloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(sf_dir), oracle_sql(), 0
    for name, build in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            df = build(spark, sf_dir)
            problems = compare(df, con, sql[name]) if name in sql else [f"no SQL, {df.count()} rows"]
        except Exception as error:  # report and go on with the other queries
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        print(f"{name:36s} {time.time() - started:6.2f}s {'ok' if not problems else problems}", flush=True)
    print(f"{failed} of {len(queries())} differ")
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]) > 0)
