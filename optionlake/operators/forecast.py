"""Walk-forward next-session surface forecasts.

A forecast surface is one row with an array of cells. Models that need no fit are
projections. Fitted models run in one task per underlying, kind of inputs and range of
consecutive splits. Of the sessions before its range a task gets only their moments, summed by
segment in a task of their own; its own sessions are added split by split. So with expanding
windows every session is read twice, whatever the number of splits.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions.grid import SurfaceGrid
from optionlake.functions.sqlmath import log_positive, not_finite
from optionlake.operators.features import FeatureSettings, feature_vector
from optionlake.operators.learners import DESIGNS, LINEAR_MODELS, Moments
from optionlake.operators.ranks import percentiles
from optionlake.operators.splits import WalkforwardSettings, date_positions, split_id
from optionlake.operators.surface import dense_rows
from optionlake.sources.stages import StageTables

PROJECTED_MODELS = {"naive": "feature_surface_mean_01", "mean5": "feature_surface_mean_05",
                    "mean22": "feature_surface_mean_22"}
FORECAST_KEYS = (N.SYMBOL, "model_name", N.DATE, N.TARGET_DATE, "split_id", N.DECISION_TS,
                 N.TARGET_TS)
FORECAST_IDS = (*N.SURFACE_IDS, "model_config_hash", "training_run_id")


def config_hash(model: str, params: Mapping[str, object]) -> Column:
    text = json.dumps({"model_name": model, **params}, sort_keys=True, separators=(",", ":"))
    return F.sha2(F.lit(text), 256)


def checked_predictions(values: Column) -> Column:
    """Predicted variances must be finite and non-negative."""
    return F.transform(values, lambda v: F.when(
        not_finite(v) | (v < 0.0),
        F.raise_error("predicted total variance must be finite and non-negative").cast("double"),
    ).otherwise(v))


def project_forecasts(features: DataFrame, test_dates: DataFrame, run_id: str,
                      models: Mapping[str, str] = PROJECTED_MODELS) -> DataFrame:
    """Forecasts that repeat a feature array; one row per model and test date."""
    rows = features.select(*N.DAY, N.TARGET_DATE, N.DECISION_TS, N.TARGET_TS, *N.SURFACE_IDS,
                           *sorted(set(models.values())))
    tested = rows.join(test_dates.select(*N.DAY, "split_id"), list(N.DAY), "inner")
    choices = F.array(*[
        F.struct(F.lit(model).alias("model_name"), F.col(array).alias("predictions"),
                 config_hash(model, {}).alias("model_config_hash"))
        for model, array in models.items()])
    opened = tested.select(*[k for k in FORECAST_KEYS if k != "model_name"], *N.SURFACE_IDS,
                           F.explode(choices).alias("m"))
    return opened.select(
        N.SYMBOL, "m.model_name", N.DATE, N.TARGET_DATE, "split_id", N.DECISION_TS, N.TARGET_TS,
        *N.SURFACE_IDS, "m.model_config_hash", F.lit(run_id).alias("training_run_id"),
        checked_predictions(F.col("m.predictions")).alias("predictions"))


@dataclass(frozen=True)
class FitPlan:
    """Which model runs with which parameters."""

    model_name: str
    params: Mapping[str, float] = field(default_factory=dict)

    @property
    def params_id(self) -> str:
        return json.dumps(dict(self.params), sort_keys=True, separators=(",", ":"))


def training_rows(features: DataFrame, settings: FeatureSettings) -> DataFrame:
    """What a fit needs per day: position, feature vector, log lags and log targets."""
    placed = features.join(date_positions(features), list(N.DAY), "inner")
    lags = [log_positive(F.col(b)) for b in settings.surface_blocks]
    return placed.select(
        *N.DAY, N.TARGET_DATE, N.DECISION_TS, N.TARGET_TS, *N.SURFACE_IDS, "position", "n_dates",
        feature_vector(settings).alias("x"), F.concat(*lags).alias("log_lags"),
        log_positive(F.col("target_total_variance")).alias("log_y"))


@dataclass(frozen=True)
class _Windows:
    """Positions that split number s is fitted on, [start(s), end(s)), and predicts, up to use_end."""

    wf: WalkforwardSettings
    extra: int      # sessions after the training block that the fit reads as well
    use: int        # sessions predicted

    def start(self, split):
        return split * (0 if self.wf.expanding_train else self.wf.step_size)

    def end(self, split):
        return split * self.wf.step_size + (self.wf.train_size + self.extra)


def _ranges(windows: _Windows, buckets: int, first_split: Column, last_split: Column) -> Column:
    """Ranges of splits (bucket, lo, hi), and the positions [base, end) that a task of one reads.

    With expanding windows, moments stand for all positions before base.
    """
    span = F.greatest(last_split - first_split + 1, F.lit(0))
    per = F.ceil(span / F.lit(buckets)).cast("int")
    spec = F.transform(
        F.sequence(F.lit(0), F.lit(buckets - 1)),
        lambda b: F.struct(
            b.cast("int").alias("bucket"), (first_split + b * per).cast("int").alias("lo"),
            F.least(last_split, first_split + (b + 1) * per - 1).cast("int").alias("hi")))
    base = windows.end if windows.wf.expanding_train else windows.start
    return F.transform(
        F.filter(spec, lambda s: s["lo"] <= s["hi"]),
        lambda s: F.struct(s["bucket"].alias("bucket"), s["lo"].alias("lo"), s["hi"].alias("hi"),
                           F.lit(base(s["lo"])).alias("base"),
                           (windows.end(s["hi"]) + windows.use).alias("end")))


def _design(pdf: pd.DataFrame, kind: str, n_cells: int) -> tuple[np.ndarray, np.ndarray]:
    x, lags, y = (np.stack(pdf[c].to_numpy()) for c in ("x", "log_lags", "log_y"))
    return DESIGNS[kind](x, lags, n_cells), y


def _segment_moments(ranged: DataFrame, kinds: Sequence[str], n_cells: int) -> DataFrame:
    """Moments of the sessions between the starts of neighbouring ranges, for each later range."""
    def summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        symbol, kind, segment, n_ranges = key
        made = Moments.of(np.hstack(_design(pdf, kind, n_cells)))
        return pd.DataFrame({N.SYMBOL: [symbol], "kind": kind, "segment": segment,
                             "n_ranges": n_ranges, "n": made.n, "mean": [made.mean],
                             "scatter": [made.scatter.tobytes()]})

    placed = ranged.select(
        N.SYMBOL, F.explode(F.array(*map(F.lit, kinds))).alias("kind"), "position", "x", "log_lags",
        "log_y", F.size("ranges").alias("n_ranges"),
        F.size(F.filter("ranges", lambda s: s["base"] <= F.col("position"))).alias("segment"))
    made = placed.filter("segment < n_ranges").groupBy(
        N.SYMBOL, "kind", "segment", "n_ranges").applyInPandas(summed, (
            f"{N.SYMBOL} string, kind string, segment int, n_ranges int, n long, "
            "mean array<double>, scatter binary"))
    return made.select(N.SYMBOL, "kind", F.explode(F.sequence(
        "segment", F.col("n_ranges") - 1)).alias("bucket"), "segment", "n", "mean", "scatter")


PREDICTED = (f"model_name string, params_id string, {N.SYMBOL} string, split_no int, {N.DATE} date, "
             "converged boolean, predictions array<double>")


def _walk_forward(rows: DataFrame, ranges: Column, plans: Sequence[FitPlan], windows: _Windows,
                  n_cells: int) -> DataFrame:
    """Predictions of every plan on each split of the ranges."""
    kinds = sorted({LINEAR_MODELS[p.model_name][0] for p in plans})
    ranged = rows.select(*N.DAY, "position", "x", "log_lags", "log_y", ranges.alias("ranges"))
    own = ranged.select("*", F.explode("ranges").alias("r")).filter(
        "position >= r.base and position < r.end").select(
            *N.DAY, "position", "x", "log_lags", "log_y", "r.*",
            F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    before = _segment_moments(ranged if windows.wf.expanding_train else ranged.limit(0), kinds, n_cells)

    def fit(key: tuple, pdf: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
        symbol, kind, _ = key
        out: list[pd.DataFrame] = []
        if len(pdf):
            pdf = pdf.sort_values("position")
            design, y = _design(pdf, kind, n_cells)
            rows_, base, width = np.hstack([design, y]), int(pdf["base"].iloc[0]), design.shape[1]
            known = Moments.of(rows_[:0])
            for _, e in earlier.sort_values("segment").iterrows():
                size = len(e["mean"])
                known = known.plus(Moments(int(e["n"]), np.asarray(e["mean"]), np.frombuffer(
                    e["scatter"]).reshape(size, size)))
            reached = base
            for split in range(int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0]) + 1):
                end = windows.end(split)
                if windows.wf.expanding_train:
                    known, reached = known.plus(Moments.of(rows_[reached - base:end - base])), end
                else:
                    known = Moments.of(rows_[windows.start(split) - base:end - base])
                use = slice(end - base, end - base + windows.use)
                for plan in plans:
                    own_kind, learner = LINEAR_MODELS[plan.model_name]
                    if own_kind == kind:
                        predict, converged = learner(known, width, n_cells, **plan.params)
                        out.append(pd.DataFrame({
                            "model_name": plan.model_name, "params_id": plan.params_id,
                            N.SYMBOL: symbol, "split_no": split, N.DATE: pdf[N.DATE].to_numpy()[use],
                            "converged": converged,
                            "predictions": list(np.exp(predict(design[use])))}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(
            columns=[c.split()[0] for c in PREDICTED.split(", ")], dtype=object)

    keys = (N.SYMBOL, "kind", "bucket")
    return own.groupBy(*keys).cogroup(before.groupBy(*keys)).applyInPandas(fit, PREDICTED)


def fit_forecasts(features: DataFrame, boundary: DataFrame, plans: Sequence[FitPlan],
                  wf: WalkforwardSettings, grid: SurfaceGrid, run_id: str,
                  settings: FeatureSettings = FeatureSettings(),
                  split_buckets: int = 8) -> DataFrame:
    """Per-underlying walk-forward fits on train plus validation rows of every clean split."""
    rows = training_rows(features, settings)
    first = boundary.select(
        N.SYMBOL, F.substring("first_clean_test_split_id", 7, 9).cast("int").alias("first_split"))
    last = F.floor((F.col("n_dates") - wf.first_test - wf.test_size)
                   / F.lit(wf.step_size)).cast("int")
    windows = _Windows(wf, wf.validation_size, wf.test_size)
    predicted = _walk_forward(
        rows.join(first, N.SYMBOL, "inner"), _ranges(windows, split_buckets, F.col("first_split"), last),
        plans, windows, grid.n_cells)
    dated = predicted.join(
        rows.select(*N.DAY, N.TARGET_DATE, N.DECISION_TS, N.TARGET_TS, *N.SURFACE_IDS),
        list(N.DAY), "inner")
    usable = F.when(~F.col("converged"),
                    F.raise_error(F.concat(F.lit("fit did not converge: "), F.col("model_name")))
                    .cast("array<double>")).otherwise(F.col("predictions"))
    return dated.select(
        N.SYMBOL, "model_name", N.DATE, N.TARGET_DATE,
        split_id(F.col("split_no")).alias("split_id"), N.DECISION_TS, N.TARGET_TS,
        *N.SURFACE_IDS, F.sha2(F.concat("model_name", "params_id"), 256)
        .alias("model_config_hash"), F.lit(run_id).alias("training_run_id"),
        checked_predictions(usable).alias("predictions"))


def validation_forecasts(features: DataFrame, plans: Sequence[FitPlan],
                         wf: WalkforwardSettings, tuning_splits: int, grid: SurfaceGrid,
                         settings: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Validation-block predictions of every parameter set on the first tuning splits."""
    rows = training_rows(features, settings)
    last = F.least(F.lit(tuning_splits - 1),
                   F.floor((F.col("n_dates") - wf.first_test - wf.test_size)
                           / F.lit(wf.step_size)).cast("int"))
    windows = _Windows(wf, 0, wf.validation_size)
    return _walk_forward(rows, _ranges(windows, tuning_splits, F.lit(0), last), plans, windows,
                         grid.n_cells)


def sweep_scores(validation: DataFrame, features: DataFrame, floor: float = 1.0e-8) -> DataFrame:
    """Mean daily observed MSE and QLIKE per parameter set and split."""
    targets = features.select(*N.DAY, "target_total_variance", "target_observed_mask",
                              "target_vega_weight")
    zipped = F.arrays_zip(F.col("predictions").alias("p"),
                          F.col("target_total_variance").alias("y"),
                          F.col("target_observed_mask").alias("m"),
                          F.col("target_vega_weight").alias("v"))
    key = ("model_name", "params_id", N.SYMBOL, "split_no")
    cells = validation.join(targets, list(N.DAY), "inner").select(
        *key, N.DATE, "converged", F.explode(zipped).alias("c")).select(
        *key, N.DATE, "converged", "c.*")
    weight = F.col("m") * F.col("v")
    error = F.col("p") - F.col("y")
    r = F.greatest(F.col("y"), F.lit(floor)) / F.greatest(F.col("p"), F.lit(floor))
    daily = cells.groupBy(*key, N.DATE).agg(
        (F.sum(weight * error * error) / F.sum(weight)).alias("mse"),
        F.avg(F.when(F.col("m") == 1.0, r - F.ln(r) - 1.0)).alias("qlike"),
        F.min("converged").alias("converged"))
    return daily.groupBy(*key).agg(
        F.avg("mse").alias("observed_mse_total_variance"),
        F.avg("qlike").alias("observed_qlike_total_variance"),
        F.min("converged").alias("converged"), F.count(F.lit(1)).alias("n_days"))


def validation_sweep(scores: DataFrame, metric: str = "observed_mse_total_variance") -> DataFrame:
    """The parameter set with the smallest mean score per model and underlying."""
    converged = scores.groupBy("model_name", N.SYMBOL, "params_id").agg(
        F.avg(metric).alias("score"), F.min("converged").alias("converged"),
        F.count(F.lit(1)).alias("n_splits")).filter("converged")
    return converged.groupBy("model_name", N.SYMBOL).agg(
        F.min_by("params_id", F.struct("score", "params_id")).alias("best_params"),
        F.min("score").alias("best_score"), F.count(F.lit(1)).alias("n_params"),
        F.max("n_splits").alias("n_splits"))


def tuning_medians(scores: DataFrame, columns: tuple[str, ...], stages: StageTables) -> DataFrame:
    """Exact median of sweep diagnostics per model; a model's rows may spread over many tasks."""
    table = scores.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_rows"))
    for c in columns:
        median = percentiles(stages, scores, ["model_name"], c, (0.5,), f"medians-{c}")
        table = table.join(median.select("model_name", F.col("value").alias(f"median_{c}")),
                           "model_name", "left")
    return table.select("model_name", *[f"median_{c}" for c in columns], "n_rows")


def check_sweep_policy(sweeps: DataFrame) -> DataFrame:
    """Underlyings whose models were tuned under different policies.

    Expects one row per model with n_splits, max_hpo_validation_date,
    first_clean_test_split_id and loss_metric.
    """
    policy = ("n_splits", "max_hpo_validation_date", "first_clean_test_split_id", "loss_metric")
    counted = sweeps.groupBy(N.SYMBOL).agg(
        *[F.count_distinct(c).alias(f"distinct_{c}") for c in policy])
    return counted.filter(" or ".join(f"distinct_{c} <> 1" for c in policy))


def write_forecasts_long(forecast_days: DataFrame, grid: SurfaceGrid) -> DataFrame:
    """The long forecast artifact: one row per forecast surface and cell; narrow."""
    arrays = forecast_days.withColumn("predicted_total_variance", F.col("predictions"))
    return dense_rows(arrays, grid, ("predicted_total_variance",),
                      (*FORECAST_KEYS, *FORECAST_IDS))


def forecast_artifact_summary(forecast_days: DataFrame, grid: SurfaceGrid) -> DataFrame:
    """Rows, date span and id counts per model."""
    return forecast_days.groupBy(N.SYMBOL, "model_name").agg(
        (F.count(F.lit(1)) * grid.n_cells).alias("row_count"),
        F.count_distinct(N.DATE).alias("quote_date_count"),
        F.count_distinct(N.TARGET_DATE).alias("target_date_count"),
        F.count_distinct("split_id").alias("split_count"),
        F.min(N.DATE).alias("first_quote_date"), F.max(N.TARGET_DATE).alias("last_target_date"),
        F.count_distinct("surface_config_hash").alias("surface_config_count"),
        F.count_distinct("model_config_hash").alias("model_config_count"),
        F.count_distinct("training_run_id").alias("training_run_count"))


def prediction_health(forecast_days: DataFrame, features: DataFrame,
                      tiny: float = 1.0e-6) -> DataFrame:
    """Mean prediction against mean target, and the share of near-zero predictions."""
    joined = forecast_days.select(N.SYMBOL, "model_name", "split_id", N.DATE, "predictions").join(
        features.select(*N.DAY, "target_total_variance"), list(N.DAY), "inner")
    zipped = F.arrays_zip(F.col("predictions").alias("p"),
                          F.col("target_total_variance").alias("y"))
    cells = joined.select(N.SYMBOL, "model_name", "split_id", F.explode(zipped).alias("c"))
    return cells.groupBy(N.SYMBOL, "model_name", "split_id").agg(
        F.avg("c.p").alias("prediction_mean"), F.avg("c.y").alias("target_mean"),
        F.try_divide(F.avg("c.p"), F.avg("c.y")).alias("prediction_target_ratio"),
        F.avg((F.col("c.p") < tiny).cast("double")).alias("near_zero_share"))
