"""Run every registered query in both engines and report differences (python -m checks.compare)."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.queries import oracle_sql, queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def local_session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted((tuple(_plain(v) for v in row) for row in rows),
                  key=lambda row: tuple((v is None, str(v)) for v in row))


def differences(spark: SparkSession, con, sf_dir: str, name: str) -> str | None:
    """None when both engines agree, else a short description."""
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = _sorted([tuple(r) for r in df.select(*columns).collect()])
    if name not in oracle_sql():
        return None if ours else "no rows"
    theirs_df = con.sql(oracle_sql()[name])
    if sorted(theirs_df.columns) != columns:
        return f"columns {columns} vs {sorted(theirs_df.columns)}"
    theirs = _sorted(theirs_df.select(*columns).fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}; first {ours[:1]} vs {theirs[:1]}"
    left, right = Counter(ours) - Counter(theirs), Counter(theirs) - Counter(ours)
    if not left and not right:
        return None
    a, b = _sorted(list(left))[0], _sorted(list(right))[0]
    return f"{sum(left.values())} of {len(ours)} rows differ, e.g. {columns} {a} vs {b}"


def main() -> None:
    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(queries())
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            found = differences(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - the report must go on
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{'DIFF' if found else 'ok  '} {name:32s} {time.time() - start:6.2f}s "
              f"{found or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree", flush=True)


if __name__ == "__main__":
    main()
