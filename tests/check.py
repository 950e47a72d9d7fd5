"""Compare every query with its SQL answer: ``python tests/check.py SF_DIR [query ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as driver  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def bag(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        return None if isinstance(value, float) and math.isnan(value) else value

    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> str | None:
    """None when equal, else what differs."""
    got = driver.queries()[name](spark, sf_dir)
    relation = con.sql(driver.oracle_sql()[name])
    if sorted(got.columns) != sorted(relation.columns):
        return f"columns {sorted(got.columns)} != {sorted(relation.columns)}"
    mine = bag([tuple(r) for r in got.collect()], got.columns)
    theirs = bag(relation.fetchall(), relation.columns)
    if mine == theirs:
        return None if mine else "both empty"
    extra, lacking = list((mine - theirs).items()), list((theirs - mine).items())
    return (
        f"{mine.total()} rows against {theirs.total()}; {len(extra)} only here, e.g. {extra[:2]}; "
        f"{len(lacking)} only there, e.g. {lacking[:2]}"
    )


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or sorted(driver.oracle_sql())
    spark = (
        SparkSession.builder.master(os.environ.get("CHECK_MASTER", "local[8]"))
        .config("spark.driver.memory", os.environ.get("CHECK_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - reported per query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")
    return min(failed, 1)


if __name__ == "__main__":
    sys.exit(main())
