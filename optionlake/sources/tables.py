"""Partitioned parquet tables and report sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optionlake import names as N
from optionlake.functions.grid import SurfaceGrid
from optionlake.operators.contracts import (check_grid_complete, check_grid_metadata,
                                            check_unique_keys, require_empty)
from optionlake.operators.evaluate import assert_equal_coverage
from optionlake.operators.forecast import write_forecasts_long
from optionlake.operators.surface import gold_rows


def write_day_partitions(df: DataFrame, path: str, within: tuple[str, ...] = ()) -> None:
    """Replace the days present in df and leave every other day of the table alone.

    With ``within`` (columns) only those parts of a day are replaced which df has rows of.

    The rebalance by day gives small days one file and lets adaptive execution split a day
    that holds very many rows over several tasks.
    """
    placed = df.withColumn("year", F.year(N.DATE)).hint("rebalance", N.DATE)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "compression", "zstd").partitionBy("year", N.DATE, *within).parquet(path)


def read_panel(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A day-partitioned table. Filters on quote_date prune its folders."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).withColumn(N.DATE, F.col(N.DATE).cast("date")).drop("year")


def read_gold_surfaces(spark: SparkSession, path: str, grid: SurfaceGrid) -> DataFrame:
    """Stored surfaces (one array row per day) in long form, after their contracts hold."""
    days = spark.read.parquet(path)
    require_empty(check_unique_keys(days, N.DAY), "gold surfaces repeat a day")
    require_empty(check_grid_metadata(days, grid).filter("n_rows > 0"), "gold grid identity")
    rows = gold_rows(days, grid)
    require_empty(check_grid_complete(rows, grid), "gold surfaces are not whole")
    return rows


def read_forecasts(spark: SparkSession, path: str, grid: SurfaceGrid) -> DataFrame:
    """Stored forecast surfaces in long form, after grid and equal-coverage checks."""
    days = spark.read.parquet(path)
    require_empty(check_grid_metadata(days, grid).filter("n_rows > 0"), "forecast grid identity")
    rows = write_forecasts_long(days, grid)
    require_empty(assert_equal_coverage(rows), "forecast models cover different cells")
    return rows


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles as fixed-point text, NaN as nan, lists as JSON, NULL as empty text."""
    def shown(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            return F.when(F.isnan(c), "nan").otherwise(F.format_string(f"%.{digits}f", c))
        if isinstance(field.dataType, T.BooleanType):
            return c.cast("string")
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(c)
        return c.cast("string")

    return df.select(*[F.when(F.col(f.name).isNull(), "").otherwise(shown(f)).alias(f.name)
                       for f in df.schema.fields])


def write_report_table(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """An ordered CSV table with six decimals plus an exact parquet copy.

    A large report is written as sorted parts, in the order of their names; a small one is one part.
    """
    def ordered(rows: DataFrame) -> DataFrame:
        return rows.orderBy(*order) if order else rows

    ordered(df).write.mode("overwrite").parquet(f"{path}/parquet")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{path}/parquet")
    rounded(ordered(stored)).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def load_test_records(spark: SparkSession, path: str, loss_metric: str,
                      exactly_one: bool = False) -> DataFrame:
    """Stored test results of one loss metric; none at all, or several for one, is an error."""
    found = spark.read.parquet(path).filter(F.col("loss_metric") == loss_metric)
    counts = found.groupBy(N.SYMBOL).agg(F.count(F.lit(1)).alias("n")).agg(
        F.max("n").alias("most")).first()
    if counts["most"] is None:
        raise ValueError(f"no test results for {loss_metric}")
    if exactly_one and counts["most"] > 1:
        raise ValueError(f"several test results for {loss_metric}")
    return found
