"""Runs registered queries in Spark and their check SQL in DuckDB and compares names, types and rows."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import duckdb  # noqa: E402

TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean",
}
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
        return "null" if value is None else str(value)

    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(frame, con, sql) -> str:
    """Empty text if both give the same columns, types and rows, else what differs."""
    described = con.execute("DESCRIBE " + sql).fetchall()
    expected_types = {row[0]: TYPES.get(row[1], row[1]) for row in described}
    actual_types = dict(frame.dtypes)
    if expected_types != actual_types:
        diff = {k: (actual_types.get(k), expected_types.get(k)) for k in {*actual_types, *expected_types}
                if actual_types.get(k) != expected_types.get(k)}
        return f"columns differ (spark, sql): {diff}"
    cursor = con.execute(sql)
    names = [row[0] for row in described]
    expected = rows_of(names, cursor.fetchall())
    actual = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    if actual == expected:
        return "" if actual else "no rows"
    extra = sorted(set(actual) - set(expected))[:3]
    missing = sorted(set(expected) - set(actual))[:3]
    return f"rows differ: {len(actual)} vs {len(expected)}; spark only {extra}; sql only {missing}; columns {sorted(names)}"


def main() -> None:
    from claimscope import build_session
    from claimscope.catalog import CHECKS, QUERIES

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir)
            problem = compare(frame, con, CHECKS[name]) if name in CHECKS else ("" if frame.count() else "no rows")
        except Exception as error:  # noqa: BLE001
            problem = "".join(traceback.format_exception_only(error))[:1500]
        seconds = time.time() - start
        print(f"{'ok ' if not problem else 'BAD'} {name} {seconds:.1f}s {problem}", flush=True)
        if problem:
            bad.append(name)
    print(len(bad), "bad:", bad)


if __name__ == "__main__":
    main()
