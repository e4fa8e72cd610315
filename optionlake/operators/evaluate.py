"""Forecasts against realised surfaces: the panel, daily losses and slices."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions.grid import SurfaceGrid
from optionlake.functions.sqlmath import qlike, total_variance_to_iv
from optionlake.operators.forecast import FORECAST_KEYS

ACTUAL_ARRAYS = ("observed_total_variance", "observed_iv", "completed_total_variance",
                 "completed_iv", "observed_mask", "completion_status", "vega_sum")
DAY_KEY = (N.SYMBOL, "model_name", N.DATE, N.TARGET_DATE)
METRICS = ("wrmse_total_variance", "wmae_total_variance", "mse_total_variance", "wrmse_iv",
           "wmae_iv", "mse_iv_change", "qlike_total_variance")


def matched_days(forecast_days: DataFrame, gold_days: DataFrame) -> DataFrame:
    """Forecast surfaces with the target-day and origin-day surfaces beside them.

    Both joins move one array row per surface. Absent partners stay as NULL for the checks.
    """
    actual = gold_days.select(
        N.SYMBOL, F.col(N.DATE).alias(N.TARGET_DATE),
        *[F.col(a).alias(f"actual_{a}") for a in (*ACTUAL_ARRAYS, N.DECISION_TS,
                                                  *N.SURFACE_IDS)])
    origin = gold_days.select(
        *N.DAY, *[F.col(a).alias(f"origin_{a}") for a in (
            "completed_total_variance", "completed_iv", "completion_status", N.DECISION_TS,
            *N.SURFACE_IDS)])
    return forecast_days.join(actual, [N.SYMBOL, N.TARGET_DATE], "left").join(
        origin, list(N.DAY), "left")


def _identity_breaks() -> dict[str, Column]:
    """Conditions of a matched surface that lacks a partner or differs from its identity."""
    pairs = [(N.TARGET_TS, f"actual_{N.DECISION_TS}"), (N.DECISION_TS, f"origin_{N.DECISION_TS}")]
    pairs += [(c, f"{side}_{c}") for side in ("actual", "origin") for c in N.SURFACE_IDS]
    return {b: ~F.col(a).eqNullSafe(F.col(b)) for a, b in pairs} | {
        f"{side}_surface": F.col(f"{side}_completed_total_variance").isNull()
        for side in ("actual", "origin")}


def panel_mismatches(matched: DataFrame) -> DataFrame:
    """How many forecast surfaces disagree with each partner's identity or lack a partner."""
    counters = _identity_breaks()
    one = matched.agg(*[F.count_if(c).alias(k) for k, c in counters.items()])
    pairs_out = F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).alias("n_rows"))
                          for k in counters])
    return one.select(F.explode(pairs_out).alias("p")).select("p.*")


def realization_panel(forecast_days: DataFrame, gold_days: DataFrame, grid: SurfaceGrid,
                      floor: float = 1.0e-8) -> DataFrame:
    """One row per forecast cell with actual and origin values, changes and weights.

    A forecast without a partner, or with another timestamp or grid than its partners, raises.
    """
    matched = matched_days(forecast_days, gold_days)
    fields = {"predicted_total_variance": "predictions",
              **{f"actual_{a}": f"actual_{a}" for a in ACTUAL_ARRAYS},
              "origin_completed_iv": "origin_completed_iv"}
    breaks = _identity_breaks()
    absent = breaks.pop("actual_surface") | breaks.pop("origin_surface")
    problem = F.when(absent, "forecast without a realised or origin surface")
    for name, differs in breaks.items():
        problem = problem.when(differs, f"forecast differs from its surfaces in {name}")
    checked = matched.withColumn("predictions", F.when(
        problem.isNotNull(), F.raise_error(problem).cast("array<double>")).otherwise(
            F.col("predictions")))
    zipped = F.arrays_zip(*[F.col(source).alias(name) for name, source in fields.items()])
    cells = checked.select(*FORECAST_KEYS, F.posexplode(zipped).alias("cell_index", "_c")).select(
        *FORECAST_KEYS, "cell_index", *[F.col("_c")[name].alias(name) for name in fields])
    placed = grid.with_coordinates(cells)
    status = F.col("actual_completion_status")
    predicted_iv = total_variance_to_iv(F.col("predicted_total_variance"),
                                        grid.tau_at(F.col("maturity_index")), floor)
    return placed.withColumn("predicted_iv", predicted_iv).withColumns({
        "actual_iv_change": F.col("actual_completed_iv") - F.col("origin_completed_iv"),
        "predicted_iv_change": F.col("predicted_iv") - F.col("origin_completed_iv"),
        "observed_weight": F.when(F.col("actual_observed_mask"),
                                  F.col("actual_vega_sum")).otherwise(0.0),
        "interpolated_weight": F.when(status == N.INTERPOLATED, 1.0).otherwise(0.0),
        "extrapolated_weight": F.when(status == N.EXTRAPOLATED, 1.0).otherwise(0.0),
        "full_grid_weight": F.lit(1.0),
    })


def _moments(scope: str, weight: Column, member: Column, floor: float) -> list[Column]:
    """Sums from which every metric of a scope follows; they add up across groups."""
    actual, predicted = F.col("actual_completed_total_variance"), F.col("predicted_total_variance")
    gap = predicted - actual
    iv_gap = F.col("predicted_iv") - F.col("actual_completed_iv")
    change_gap = F.col("predicted_iv_change") - F.col("actual_iv_change")

    def total(value: Column) -> Column:
        return F.sum(F.when(member, value))

    return [
        total(weight).alias(f"{scope}_w"),
        total(weight * gap * gap).alias(f"{scope}_gap2"),
        total(weight * F.abs(gap)).alias(f"{scope}_gap"),
        total(weight * iv_gap * iv_gap).alias(f"{scope}_iv2"),
        total(weight * F.abs(iv_gap)).alias(f"{scope}_iv"),
        total(weight * change_gap * change_gap).alias(f"{scope}_change2"),
        total(qlike(actual, predicted, floor)).alias(f"{scope}_ql"),
        F.count_if(member).alias(f"{scope}_n"),
    ]


def _scope_moments(floor: float) -> list[Column]:
    observed = F.col("actual_observed_mask")
    return [*_moments("observed", F.col("observed_weight"), observed, floor),
            *_moments("full", F.lit(1.0), F.lit(True), floor)]


def _metrics(scope: str) -> dict[str, Column]:
    def mean(name: str) -> Column:
        return F.try_divide(F.col(f"{scope}_{name}"), F.col(f"{scope}_w"))

    return {
        "wrmse_total_variance": F.sqrt(mean("gap2")),
        "wmae_total_variance": mean("gap"),
        "mse_total_variance": mean("gap2"),
        "wrmse_iv": F.sqrt(mean("iv2")),
        "wmae_iv": mean("iv"),
        "mse_iv_change": mean("change2"),
        "qlike_total_variance": F.try_divide(F.col(f"{scope}_ql"), F.col(f"{scope}_n")),
    }


def daily_loss(panel: DataFrame, floor: float = 1.0e-8) -> DataFrame:
    """Seven metrics in observed and full scope per model and day, in one aggregate.

    A day without positive observed weight raises.
    """
    status = F.col("actual_completion_status")
    sums = panel.groupBy(*DAY_KEY).agg(
        *_scope_moments(floor),
        F.count_if(status == N.INTERPOLATED).alias("interpolated_cell_count"),
        F.count_if(status == N.EXTRAPOLATED).alias("extrapolated_cell_count"))
    weightless = ~F.coalesce(F.col("observed_w") > 0.0, F.lit(False))
    guarded = sums.withColumn("observed_w", F.when(
        weightless, F.raise_error("a target day has no positive observed weight")
        .cast("double")).otherwise(F.col("observed_w")))
    return guarded.select(
        *DAY_KEY,
        *[c.alias(f"{scope}_{m}") for scope in ("observed", "full")
          for m, c in _metrics(scope).items()],
        "interpolated_cell_count", "extrapolated_cell_count",
        F.col("observed_n").alias("observed_cell_count"),
        F.col("full_n").alias("full_grid_cell_count"))


def mean_daily_loss(daily: DataFrame, metric: str,
                    keys: tuple[str, ...] = (N.SYMBOL, "model_name")) -> DataFrame:
    return daily.groupBy(*keys).agg(F.avg(metric).alias("mean_daily_loss"),
                                    F.count(F.lit(1)).alias("n_target_dates"))


def loss_summary(daily: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of daily losses per model."""
    return daily.groupBy(N.SYMBOL, "model_name").agg(
        *[F.avg(m).alias(f"mean_{m}") for m in metrics],
        *[F.stddev_samp(m).alias(f"std_{m}") for m in metrics],
        F.count(F.lit(1)).alias("n_target_dates"))


def day_win_counts(daily: DataFrame, metric: str, benchmark: str) -> DataFrame:
    """Days each model beats or trails the benchmark, mean and median difference.

    A median per underlying and model reads at most one value per session. A day on which the
    benchmark has no loss raises.
    """
    base = daily.filter(F.col("model_name") == benchmark).select(
        *N.DAY, N.TARGET_DATE, F.col(metric).alias("base"))
    known = F.when(F.col("base").isNull(), F.raise_error("a day has no benchmark loss")
                   .cast("double")).otherwise(F.col("base"))
    gap = daily.join(base, [*N.DAY, N.TARGET_DATE], "left").filter(
        F.col("model_name") != benchmark).withColumn("gap", F.col(metric) - known)
    return gap.groupBy(N.SYMBOL, "model_name").agg(
        F.count_if(F.col("gap") < 0.0).alias("days_better"),
        F.count_if(F.col("gap") > 0.0).alias("days_worse"),
        F.avg("gap").alias("mean_difference"),
        F.percentile("gap", F.lit(0.5)).alias("median_difference"),
        F.count(F.lit(1)).alias("n_days"))


StressWindow = tuple[str, dt.date, dt.date]


def in_stress_windows(date: Column, windows: Sequence[StressWindow]) -> Column:
    """Labels of the (few, possibly overlapping) closed windows that hold a date."""
    if not windows:
        return F.array().cast("array<string>")
    labels = F.array(*[F.when(date.between(F.lit(a), F.lit(b)), label) for label, a, b in windows])
    return F.array_compact(labels)


def slice_metrics(panel: DataFrame, stress_windows: Sequence[StressWindow],
                  floor: float = 1.0e-8) -> DataFrame:
    """Pooled metrics by maturity, moneyness and stress window in both scopes.

    Sums are first taken per target day, next to the data, and then pooled; counting days is
    then a plain count and no distinct aggregate is needed. An empty observed slice gives NaN.
    """
    def member(family: str, label: Column, value: Column) -> Column:
        return F.struct(F.lit(family).alias("slice_family"), label.alias("slice_label"),
                        value.cast("double").alias("slice_value_float"))

    slices = F.concat(
        F.array(
            member("maturity", F.concat(F.col("maturity_days").cast("string"), F.lit("d")),
                   F.col("maturity_days")),
            member("moneyness", F.format_string("%+.2f", "moneyness_point"),
                   F.col("moneyness_point"))),
        F.transform(in_stress_windows(F.col(N.TARGET_DATE), stress_windows),
                    lambda label: member("stress_window", label, F.lit(None))))
    slice_key = ("slice_family", "slice_label", "slice_value_float")
    needed = ("actual_completed_total_variance", "predicted_total_variance", "predicted_iv",
              "actual_completed_iv", "predicted_iv_change", "actual_iv_change",
              "actual_observed_mask", "observed_weight")
    opened = panel.select(N.SYMBOL, "model_name", N.TARGET_DATE, *needed,
                          F.explode(slices).alias("_s")).select("*", "_s.*").drop("_s")
    moments = _scope_moments(floor)
    per_day = opened.groupBy(N.SYMBOL, "model_name", N.TARGET_DATE, *slice_key).agg(*moments)
    names = [c for c in per_day.columns
             if c.startswith(("observed_", "full_")) and c not in ("observed_weight",)]
    pooled = per_day.groupBy(N.SYMBOL, "model_name", *slice_key).agg(
        *[F.sum(c).alias(c) for c in names],
        F.count_if(F.col("observed_n") > 0).alias("observed_days"),
        F.count(F.lit(1)).alias("full_days"))
    nan = F.lit(float("nan"))
    scopes = F.array(*[
        F.struct(F.lit(scope).alias("evaluation_scope"),
                 *[F.coalesce(c, nan).alias(m) for m, c in _metrics(scope).items()],
                 F.col(f"{scope}_n").alias("cell_count"),
                 F.col(f"{scope}_days").alias("target_day_count"))
        for scope in ("observed", "full")])
    return pooled.select(N.SYMBOL, "model_name", *slice_key, F.explode(scopes).alias("_s")).select(
        N.SYMBOL, "model_name", *slice_key, "_s.*")


def assert_equal_coverage(forecast_rows: DataFrame) -> DataFrame:
    """Cells that some model lacks or repeats.

    The number of models is a sum over (underlying, model) counts, so one hash aggregate per
    cell plus a tiny one suffices.
    """
    cell = (N.SYMBOL, N.DATE, N.TARGET_DATE, "split_id", "maturity_index", "moneyness_index")
    models = forecast_rows.groupBy(N.SYMBOL, "model_name").agg(
        F.count(F.lit(1)).alias("n")).groupBy(N.SYMBOL).agg(
        F.count(F.lit(1)).alias("n_models_expected"))
    per_model = forecast_rows.groupBy(*cell, "model_name").agg(F.count(F.lit(1)).alias("n"))
    per_cell = per_model.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_models"), F.max("n").alias("max_repeats"))
    return per_cell.join(models, N.SYMBOL, "inner").filter(
        (F.col("n_models") != F.col("n_models_expected")) | (F.col("max_repeats") > 1))


def assert_after_boundary(forecast_days: DataFrame, boundary: DataFrame) -> DataFrame:
    """Forecast origins on or before the last validation date used for tuning."""
    limit = boundary.select(N.SYMBOL, "max_hpo_validation_date")
    return forecast_days.select(N.SYMBOL, "model_name", N.DATE).join(
        limit, N.SYMBOL, "inner").filter(F.col(N.DATE) <= F.col("max_hpo_validation_date"))


def check_boundary_match(recorded: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Underlyings whose recorded tuning boundary differs from the recomputed one."""
    fields = ("max_hpo_validation_date", "first_clean_test_split_id")
    a = recorded.select(N.SYMBOL, *[F.col(f).alias(f"recorded_{f}") for f in fields])
    b = recomputed.select(N.SYMBOL, *fields)
    return a.join(b, N.SYMBOL, "full").filter(
        " or ".join(f"not (recorded_{f} <=> {f})" for f in fields))
