"""Data contracts: each check returns the violating rows or counts; `require_empty` raises."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions.grid import SurfaceGrid
from optionlake.functions.sqlmath import not_finite
from optionlake.operators.features import role_of_column


class ContractError(ValueError):
    """A table broke a contract that was checked in strict mode."""


def require_empty(violations: DataFrame, what: str) -> None:
    """Strict mode: raise when a violation table has any row (five are shown)."""
    sample = violations.limit(5).collect()
    if sample:
        raise ContractError(f"{what}: {[row.asDict() for row in sample]}")


def check_header(columns: list[str], required: tuple[str, ...],
                 allowed_extra: tuple[str, ...]) -> None:
    missing = [c for c in required if c not in columns]
    unknown = [c for c in columns if c not in required and c not in allowed_extra]
    if missing or unknown:
        raise ContractError(f"schema drift: missing={missing} unexpected={unknown}")


def _counts_as_rows(df: DataFrame, counters: dict[str, object], name: str) -> DataFrame:
    """One aggregate pass over the data, reported as (name, n_rows) rows."""
    one = df.agg(*[F.count_if(cond).alias(label) for label, cond in counters.items()])
    pairs = F.array(*[F.struct(F.lit(label).alias(name), F.col(label).alias("n_rows"))
                      for label in counters])
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def check_non_null(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return _counts_as_rows(df, {c: F.col(c).isNull() for c in columns}, "column_name")


def check_finite(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return _counts_as_rows(df, {c: not_finite(c) for c in columns}, "column_name")


def check_nonnegative(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return _counts_as_rows(df, {c: F.col(c) < 0.0 for c in columns}, "column_name")


def check_equal_columns(df: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    return _counts_as_rows(
        df, {f"{a}={b}": ~F.col(a).eqNullSafe(F.col(b)) for a, b in pairs}, "comparison")


def check_single_date(quotes: DataFrame) -> DataFrame:
    """Files that do not hold exactly one quote date."""
    return quotes.groupBy("source_zip").agg(
        F.count_distinct(N.DATE).alias("n_quote_dates")).filter("n_quote_dates <> 1")


def check_symbols(quotes: DataFrame, symbols: tuple[str, ...]) -> DataFrame:
    """Row counts of underlyings that were not asked for."""
    return quotes.filter(~F.col(N.SYMBOL).isin(*symbols)).groupBy(N.SYMBOL).agg(
        F.count(F.lit(1)).alias("n_rows"))


def check_window(df: DataFrame, start: dt.date, end: dt.date,
                 date_column: str = N.DATE) -> DataFrame:
    """Dates outside the closed sample window."""
    inside = F.col(date_column).between(F.lit(start), F.lit(end))
    return df.filter(~F.coalesce(inside, F.lit(False))).groupBy(date_column).agg(
        F.count(F.lit(1)).alias("n_rows"))


def check_unique_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once; counts combine before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def missing_keys(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys on one side only, with the side that lacks them."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    absent = a.join(b, list(keys), "left_anti").withColumn("violation", F.lit("MISSING"))
    extra = b.join(a, list(keys), "left_anti").withColumn("violation", F.lit("UNEXPECTED"))
    return absent.unionByName(extra)


def check_grid_complete(rows: DataFrame, grid: SurfaceGrid,
                        keys: tuple[str, ...] = N.DAY) -> DataFrame:
    """Surfaces whose cells are duplicated, unknown or not all there; one aggregate."""
    cell = grid.cell_index(F.col("maturity_index"), F.col("moneyness_index"))
    known = (
        F.col("maturity_index").between(0, grid.n_maturities - 1)
        & F.col("moneyness_index").between(0, grid.n_moneyness - 1)
    )
    matches = known & (F.col("maturity_days") == grid.maturity_days_at(F.col("maturity_index"))) \
        & (F.col("moneyness_point") == grid.moneyness_at(F.col("moneyness_index")))
    per_cell = rows.withColumn("_ok", F.coalesce(
        F.when(known, matches), F.lit(False))).groupBy(*keys, F.when(known, cell).alias("cell")) \
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_ok")).alias("bad"))
    return per_cell.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.count("cell").alias("n_distinct_cells"),
        F.sum(F.when(F.col("cell").isNotNull(), F.col("n") - 1).otherwise(0))
        .alias("n_duplicates"),
        F.sum("bad").alias("n_foreign"),
    ).filter((F.col("n_distinct_cells") != grid.n_cells) | (F.col("n_duplicates") > 0)
             | (F.col("n_foreign") > 0))


def check_grid_metadata(rows: DataFrame, grid: SurfaceGrid) -> DataFrame:
    """Identity values that differ from the grid's own."""
    expected = {
        "surface_grid_schema_version": N.GRID_SCHEMA_VERSION,
        "surface_grid_hash": grid.grid_hash,
        "maturity_coordinate": N.MATURITY_COORDINATE,
        "moneyness_coordinate": N.MONEYNESS_COORDINATE,
    }
    return _counts_as_rows(
        rows, {c: ~F.col(c).eqNullSafe(F.lit(v)) for c, v in expected.items()}, "column_name")


def infer_grid(rows: DataFrame) -> DataFrame:
    """The grid found in a long table: axis, index, coordinate and whether they are one-to-one."""
    axes = (("maturity", "maturity_index", F.col("maturity_days").cast("double")),
            ("moneyness", "moneyness_index", F.col("moneyness_point")))
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(i).alias("axis_index"),
                               c.alias("coordinate")) for a, i, c in axes])
    found = rows.select(F.explode(pairs).alias("p")).select("p.*").groupBy(
        "axis", "axis_index", "coordinate").agg(F.count(F.lit(1)).alias("n_rows"))
    per_index = found.groupBy("axis", "axis_index").agg(
        F.min("coordinate").alias("coordinate"), F.count(F.lit(1)).alias("n_coordinates"),
        F.sum("n_rows").alias("n_rows"))
    line = Window.partitionBy("axis").orderBy("axis_index")
    contiguous = F.col("axis_index") == F.row_number().over(line) - 1
    rising = F.coalesce(F.col("coordinate") > F.lag("coordinate").over(line), F.lit(True))
    return per_index.select(
        "axis", "axis_index", "coordinate", "n_rows",
        (contiguous & rising & (F.col("n_coordinates") == 1)).alias("is_consistent"))


def check_dates_increasing(days: DataFrame) -> DataFrame:
    """Dates an underlying lists more than once (its dates must strictly increase)."""
    return check_unique_keys(days, N.DAY)


def check_target_alignment(features: DataFrame, days: DataFrame) -> DataFrame:
    """Feature rows whose target is not the next observed date of the underlying."""
    line = Window.partitionBy(N.SYMBOL).orderBy(N.DATE)
    following = days.select(*N.DAY).distinct().withColumn(
        "expected_target_date", F.lead(N.DATE).over(line))
    return features.select(*N.DAY, N.TARGET_DATE).join(following, list(N.DAY), "left").filter(
        ~F.col(N.TARGET_DATE).eqNullSafe(F.col("expected_target_date")))


def check_mask_weights(panel: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Surfaces whose observed weights contradict the mask or sum to nothing."""
    mask, weight = F.col("actual_observed_mask"), F.col("observed_weight")
    return panel.groupBy(*keys).agg(
        F.count_if(mask.isNull()).alias("n_null_mask"),
        F.count_if(not_finite(weight) | (weight < 0.0)).alias("n_bad_weight"),
        F.count_if(mask & (weight <= 0.0)).alias("n_unweighted"),
        F.count_if(~mask & (weight != 0.0)).alias("n_weighted_off_mask"),
        F.sum(F.when(mask, weight).otherwise(0.0)).alias("weight_sum"),
    ).filter("n_null_mask + n_bad_weight + n_unweighted + n_weighted_off_mask > 0 "
             "or not weight_sum > 0")


def leakage_check(features: DataFrame, lineage: DataFrame | None = None) -> DataFrame:
    """Feature rows known too late, or targets not after the decision, per column role.

    With ``feature_lineage`` a feature is judged by the newest surface that went into it, and counts
    as late too if its lineage is unknown; without, by the instant its role declares.
    """
    traced = set()
    if lineage is not None:
        traced = set(lineage.schema["newest"].dataType.names)
        features = features.join(lineage, list(N.DAY), "left")
    known = [(c, *role_of_column(c)) for c in features.columns if c != "newest"]
    late = {}
    for column, role, reference in known:
        if column in traced:
            newest = F.col(f"newest.{column}")
            late[column] = newest.isNull() | (newest > F.to_timestamp(N.DECISION_TS))
        elif role == "model_feature":
            late[column] = F.col(reference) > F.col(N.DECISION_TS)
        elif role in ("target", "target_weight"):
            late[column] = F.col(reference) <= F.col(N.DECISION_TS)
    late["target_date"] = F.col(N.TARGET_DATE) <= F.col(N.DATE)
    return _counts_as_rows(features, late, "column_name")


def check_min_history(days: DataFrame, required: int) -> DataFrame:
    """Underlyings with too few dates to build a supervised table."""
    return days.select(*N.DAY).distinct().groupBy(N.SYMBOL).agg(
        F.count(F.lit(1)).alias("n_dates")).filter(F.col("n_dates") < required)


def all_of(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)
