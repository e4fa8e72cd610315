"""Blocked walk-forward splits over each underlying's dates.

Membership is computed from a date's position by arithmetic: every date lists the splits it
belongs to, so dates and splits are never joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optionlake import names as N


@dataclass(frozen=True)
class WalkforwardSettings:
    train_size: int = 504
    validation_size: int = 126
    test_size: int = 21
    step_size: int = 21
    expanding_train: bool = True

    def __post_init__(self) -> None:
        if min(self.train_size, self.validation_size, self.test_size, self.step_size) < 1:
            raise ValueError("split sizes must be positive")

    @property
    def first_test(self) -> int:
        return self.train_size + self.validation_size


def split_id(number: Column) -> Column:
    return F.format_string("split_%04d", number)


def date_positions(days: DataFrame) -> DataFrame:
    """0-based position of each distinct date of an underlying, and how many it has."""
    dates = days.select(*N.DAY).distinct()
    line = Window.partitionBy(N.SYMBOL).orderBy(N.DATE)
    return dates.select(
        *N.DAY, (F.row_number().over(line) - 1).alias("position"),
        F.count(F.lit(1)).over(Window.partitionBy(N.SYMBOL)).cast("int").alias("n_dates"))


def walkforward_splits(days: DataFrame, settings: WalkforwardSettings) -> DataFrame:
    """(underlying, split_no, split_id, role, quote_date); only full test windows count."""
    s, step = settings, settings.step_size
    i = F.col("position")

    def quotient(value: Column) -> Column:
        return F.floor(value / F.lit(step)).cast("int")

    last = quotient(F.col("n_dates") - s.first_test - s.test_size)
    test_last = quotient(i - s.first_test)
    validation_last = quotient(i - s.train_size)
    train_last = last if s.expanding_train else F.least(last, quotient(i))
    def span(role: str, low: Column, high: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), low.alias("lo"), high.alias("hi"))

    ranges = F.array(
        span("train", validation_last + 1, train_last),
        span("validation", test_last + 1, F.least(last, validation_last)),
        span("test", quotient(i - s.first_test - s.test_size) + 1, F.least(last, test_last)))
    ranged = date_positions(days).select(*N.DAY, F.explode(ranges).alias("r")).select(
        *N.DAY, "r.role", F.greatest(F.col("r.lo"), F.lit(0)).alias("lo"), "r.hi")
    return (
        ranged.filter(F.col("lo") <= F.col("hi"))
        .select(N.SYMBOL, F.explode(F.sequence("lo", "hi")).alias("split_no"), "role", N.DATE)
        .select(N.SYMBOL, "split_no", split_id(F.col("split_no")).alias("split_id"), "role",
                N.DATE)
    )


def _split_edges(splits: DataFrame, tuning_splits: int) -> DataFrame:
    """Per split: first test date, plus the last validation date used for tuning."""
    edges = splits.groupBy(N.SYMBOL, "split_no", "split_id").agg(
        F.max(F.when(F.col("role") == "validation", F.col(N.DATE))).alias("last_validation"),
        F.min(F.when(F.col("role") == "test", F.col(N.DATE))).alias("first_test"))
    used = F.when(F.col("split_no") < tuning_splits, F.col("last_validation"))
    return edges.withColumn("max_hpo_validation_date",
                            F.max(used).over(Window.partitionBy(N.SYMBOL)))


def clean_boundary(splits: DataFrame, tuning_splits: int) -> DataFrame:
    """Last tuning validation date and the first split tested after it, per underlying."""
    edges = _split_edges(splits, tuning_splits)
    clean = F.col("first_test") > F.col("max_hpo_validation_date")
    return edges.groupBy(N.SYMBOL).agg(
        F.max("max_hpo_validation_date").alias("max_hpo_validation_date"),
        F.min_by(F.when(clean, F.col("split_id")), F.when(clean, F.col("split_no"))).alias(
            "first_clean_test_split_id"),
        F.count(F.lit(1)).alias("n_splits"),
        F.count_if(clean).alias("n_clean_splits"))


def clean_splits(splits: DataFrame, tuning_splits: int) -> DataFrame:
    """Memberships of the splits whose test window starts after the tuning boundary."""
    edges = _split_edges(splits, tuning_splits).filter(
        F.col("first_test") > F.col("max_hpo_validation_date"))
    return splits.join(edges.select(N.SYMBOL, "split_no"), [N.SYMBOL, "split_no"], "left_semi")


def universe_hash(days: DataFrame) -> DataFrame:
    """SHA-256 of the compact JSON list of an underlying's ISO dates."""
    dates = days.select(N.SYMBOL, F.col(N.DATE).cast("string").alias("d")).distinct()
    return dates.groupBy(N.SYMBOL).agg(
        F.sha2(F.to_json(F.sort_array(F.collect_list("d"))), 256).alias("universe_hash"),
        F.count(F.lit(1)).alias("n_dates"))


def check_splits(splits: DataFrame, days: DataFrame, settings: WalkforwardSettings) -> DataFrame:
    """Violations: memberships absent from or foreign to a recomputation, or double roles."""
    key = [N.SYMBOL, "split_id", "role", N.DATE]
    expected = walkforward_splits(days, settings).select(*key)
    given = splits.select(*key)
    missing = expected.join(given, key, "left_anti").withColumn("violation", F.lit("MISSING"))
    extra = given.join(expected, key, "left_anti").withColumn("violation", F.lit("UNEXPECTED"))
    twice = given.groupBy(N.SYMBOL, "split_id", N.DATE).agg(
        F.count(F.lit(1)).alias("n"), F.max("role").alias("role")).filter("n > 1").select(
        *key, F.lit("OVERLAP").alias("violation"))
    return missing.unionByName(extra).unionByName(twice)
