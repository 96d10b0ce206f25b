"""Run queries and their check SQL side by side and compare the rows.

    python -m workload.check [folder] [query ...]
"""

from __future__ import annotations

import decimal
import sys
import time
from pathlib import Path
from typing import Any

import duckdb
from pyspark.sql import DataFrame, SparkSession

from .oracles import ORACLES
from .queries import QUERIES


def cell(value: Any) -> Any:
    """A value in a form that compares alike from both engines."""
    if isinstance(value, decimal.Decimal):
        value = int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def oracle_rows(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as db:
        for path in Path(folder).glob("*.parquet"):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        result = db.execute(sql)
        return [d[0] for d in result.description], result.fetchall()


def compare(df: DataFrame, folder: str, sql: str) -> str:
    """Empty when the rows agree, else what differs."""
    names, expected = oracle_rows(folder, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} but expected {sorted(names)}"
    actual = rows_of(df.columns, [tuple(row) for row in df.collect()])
    wanted = rows_of(names, expected)
    if actual == wanted:
        return ""
    extra = [row for row in actual if row not in wanted][:3] if len(actual) < 5000 else "?"
    lacking = [row for row in wanted if row not in actual][:3] if len(wanted) < 5000 else "?"
    first = next((pair for pair in zip(actual, wanted) if pair[0] != pair[1]), None)
    return f"{len(actual)} rows, expected {len(wanted)}; extra {extra}; lacking {lacking}; first {first}"


def main(arguments: list[str]) -> int:
    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    chosen = arguments[1:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    failed = 0
    for name in chosen:
        start = time.perf_counter()
        try:
            df = QUERIES[name](spark, folder)
            if name not in ORACLES:
                verdict = f"no SQL, {df.count()} rows"
            else:
                verdict = compare(df, folder, ORACLES[name]) or "ok"
        except Exception as exc:
            verdict = f"error {type(exc).__name__}: {str(exc)[:600]}"
        failed += verdict != "ok" and not verdict.startswith("no SQL")
        print(f"{name:28s} {time.perf_counter() - start:6.2f}s {verdict[:900]}", flush=True)
        spark.catalog.clearCache()
    print(f"{failed} of {len(chosen)} differ")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
