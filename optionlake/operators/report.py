"""Ranked report tables.

All ranking windows are per underlying (and model, slice or cell), so a group holds at most
one value per session or model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions.sqlmath import nearest_rank, ratio

SLICE = ("slice_family", "slice_label", "evaluation_scope")


def _improvement(base: Column, value: Column) -> Column:
    """Percent improvement over the benchmark; NULL for a zero benchmark."""
    return ratio(base - value, base) * 100.0


def _benchmark(value: str, benchmark: str, *keys: str) -> Column:
    group = Window.partitionBy(*keys)
    return F.max(F.when(F.col("model_name") == benchmark, F.col(value))).over(group)


def _require_benchmark(df: DataFrame, benchmark: str, *keys: str) -> DataFrame:
    present = F.max(F.col("model_name") == benchmark).over(Window.partitionBy(*keys))
    return df.withColumn("model_name", F.when(
        ~present, F.raise_error(f"benchmark model {benchmark} is missing").cast("string"))
        .otherwise(F.col("model_name")))


def _ranked(summary: DataFrame, metric: str, benchmark: str) -> DataFrame:
    order = Window.partitionBy(N.SYMBOL).orderBy(metric, "model_name")
    checked = _require_benchmark(summary, benchmark, N.SYMBOL)
    return checked.withColumns({
        "rank": F.row_number().over(order).cast("long"),
        "improvement_vs_benchmark_pct": _improvement(
            _benchmark(metric, benchmark, N.SYMBOL), F.col(metric))})


def ranked_loss(summary: DataFrame, metric: str, benchmark: str) -> DataFrame:
    """Loss ranking with improvement over the benchmark; metric is a mean_ column."""
    deviation = metric.replace("mean_", "std_", 1)
    columns = ["model_name", metric, *[c for c in (deviation, "n_target_dates")
                                       if c in summary.columns and c != metric]]
    ranked = _ranked(summary.select(N.SYMBOL, *columns), metric, benchmark)
    return ranked.select(N.SYMBOL, "rank", *columns, "improvement_vs_benchmark_pct")


def ranked_hedging(summary: DataFrame, benchmark: str,
                   metric: str = "mean_abs_revaluation_error") -> DataFrame:
    return _ranked(summary, metric, benchmark)


def tail_risk(daily: DataFrame, metric: str, benchmark: str) -> DataFrame:
    """Upper quantiles (nearest rank) of daily losses against the benchmark's."""
    series = Window.partitionBy(N.SYMBOL, "model_name")
    placed = daily.select(
        N.SYMBOL, "model_name", F.col(metric).alias("loss"),
        F.row_number().over(series.orderBy(metric)).alias("position"),
        F.count(F.lit(1)).over(series).alias("n"))

    def quantile(q: float) -> Column:
        return F.max(F.when(F.col("position") == nearest_rank(F.col("n"), q), F.col("loss")))

    summary = placed.groupBy(N.SYMBOL, "model_name").agg(
        F.avg("loss").alias("mean_loss"), quantile(0.90).alias("p90_loss"),
        quantile(0.95).alias("p95_loss"), quantile(0.99).alias("p99_loss"),
        F.max("loss").alias("max_loss"), F.count(F.lit(1)).alias("n_target_dates"))
    checked = _require_benchmark(summary, benchmark, N.SYMBOL)
    return checked.select(
        N.SYMBOL, F.lit(metric).alias("loss_metric"), "model_name", "mean_loss", "p90_loss",
        "p95_loss", "p99_loss", "max_loss",
        _improvement(_benchmark("p95_loss", benchmark, N.SYMBOL), F.col("p95_loss"))
        .alias("p95_improvement_vs_benchmark_pct"),
        _improvement(_benchmark("max_loss", benchmark, N.SYMBOL), F.col("max_loss"))
        .alias("max_improvement_vs_benchmark_pct"),
        "n_target_dates")


def worst_days(daily: DataFrame, metric: str, benchmark: str, top_n: int = 5) -> DataFrame:
    """The top_n largest losses of each model with the benchmark's loss on the same day."""
    losses = daily.select(N.SYMBOL, "model_name", N.DATE, N.TARGET_DATE,
                          F.col(metric).alias("loss_value"))
    base = losses.filter(F.col("model_name") == benchmark).select(
        N.SYMBOL, N.DATE, N.TARGET_DATE, F.col("loss_value").alias("benchmark_loss_value"))
    order = Window.partitionBy(N.SYMBOL, "model_name").orderBy(
        F.col("loss_value").desc(), N.DATE, N.TARGET_DATE)
    top = losses.withColumn("rank_within_model", F.row_number().over(order).cast("long")).filter(
        F.col("rank_within_model") <= top_n)
    joined = top.join(base, [N.SYMBOL, N.DATE, N.TARGET_DATE], "left")
    value, reference = F.col("loss_value"), F.col("benchmark_loss_value")
    return joined.select(
        N.SYMBOL, F.lit(metric).alias("loss_metric"), "model_name", "rank_within_model", N.DATE,
        N.TARGET_DATE, "loss_value", F.lit(benchmark).alias("benchmark_model"),
        "benchmark_loss_value", (value - reference).alias("excess_loss_vs_benchmark"),
        F.when(reference > 0.0, ratio(value, reference)).alias("loss_ratio_vs_benchmark"))


def slice_leaders(slices: DataFrame, metric: str, benchmark: str) -> DataFrame:
    """Best model of each slice; NaN ranks last and a zero benchmark gives NaN."""
    group = (N.SYMBOL, *SLICE)
    checked = _require_benchmark(slices, benchmark, *group)
    order = Window.partitionBy(*group).orderBy(metric, "model_name")
    base = _benchmark(metric, benchmark, *group)
    best = checked.select(
        *group, F.col("model_name").alias("best_model_name"),
        F.col(metric).alias("best_metric_value"), F.lit(benchmark).alias("benchmark_model"),
        base.alias("benchmark_metric_value"), F.row_number().over(order).alias("_rank")
    ).filter("_rank = 1")
    reference, value = F.col("benchmark_metric_value"), F.col("best_metric_value")
    pct = F.when(reference == 0.0, F.lit(float("nan"))).otherwise(
        ratio(reference - value, reference) * 100.0)
    return best.withColumn("improvement_vs_benchmark_pct", pct).drop("_rank")


def cell_leaders(panel: DataFrame, benchmark: str) -> DataFrame:
    """Best model per surface cell under weighted observed MSE; ties go to the first name."""
    error = F.col("predicted_total_variance") - F.col("actual_completed_total_variance")
    weight = F.col("observed_weight")
    cell = (N.SYMBOL, "maturity_days", "moneyness_point")
    per_model = panel.filter("actual_observed_mask").groupBy(*cell, "model_name").agg(
        F.sum(weight * error * error).alias("_error"), F.sum(weight).alias("_weight"),
        F.count(F.lit(1)).alias("n_observed_days")
    ).withColumn("cell_mse", F.when(F.col("_weight") > 0.0,
                                    ratio(F.col("_error"), F.col("_weight"))))
    group = Window.partitionBy(*cell)
    of_benchmark = F.col("model_name") == benchmark
    ranked = per_model.select(
        *cell, F.col("model_name").alias("best_model_name"),
        F.col("cell_mse").alias("best_cell_mse"), F.lit(benchmark).alias("benchmark_model"),
        F.max(F.when(of_benchmark, F.col("cell_mse"))).over(group).alias("benchmark_cell_mse"),
        "n_observed_days",
        F.max(F.when(of_benchmark, F.col("n_observed_days"))).over(group)
        .alias("benchmark_observed_days"),
        F.row_number().over(group.orderBy("cell_mse", "model_name")).alias("_rank"))
    base = F.col("benchmark_cell_mse")
    return ranked.filter("_rank = 1").drop("_rank").withColumn(
        "improvement_vs_benchmark_pct",
        F.when(base > 0.0, ratio(base - F.col("best_cell_mse"), base) * 100.0).otherwise(0.0))


def dm_table(tests: DataFrame) -> DataFrame:
    """Test results ranked by p-value within underlying and metric."""
    order = Window.partitionBy(N.SYMBOL, "loss_metric").orderBy("p_value", "model_b")
    return tests.select(N.SYMBOL, "loss_metric", F.row_number().over(order).cast("long")
                        .alias("p_rank"), "model_a", "model_b", "n_obs", "mean_differential",
                        "statistic", "p_value", "alternative")


def spa_table(tests: DataFrame) -> DataFrame:
    """One flat row per underlying and metric, list fields as text."""
    return tests.select(
        N.SYMBOL, "loss_metric", "benchmark_model",
        F.array_join("candidate_models", ",").alias("candidate_models"), "observed_statistic",
        "p_value", F.array_join("superior_models_by_mean", ",").alias("superior_models_by_mean"),
        "alpha", "block_size", "bootstrap_reps")


def mcs_table(sets: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per model with its inclusion; a retained model without losses raises."""
    models = summary.groupBy(N.SYMBOL).agg(F.sort_array(F.collect_set("model_name"))
                                           .alias("all_models"))
    joined = sets.join(models, N.SYMBOL, "inner")
    stray = F.size(F.array_except("superior_models", "all_models")) > 0
    listed = F.when(stray, F.raise_error("retained model is missing from the loss summary")
                    .cast("array<string>")).otherwise(F.col("all_models"))
    opened = joined.select(N.SYMBOL, "loss_metric", "alpha", "superior_models",
                           F.explode(listed).alias("model_name"))
    return opened.select(
        N.SYMBOL, "loss_metric", "model_name",
        F.array_contains("superior_models", F.col("model_name"))
        .alias("included_in_simplified_tmax_set"),
        F.col("alpha").alias("simplified_tmax_alpha"))


def relative_ranking(summary: DataFrame, metric: str, benchmark: str) -> DataFrame:
    """Loss over benchmark loss with zeros lifted to a display floor."""
    value = F.col(metric)
    group = Window.partitionBy(N.SYMBOL)
    floor = F.coalesce(F.min(F.when(value > 0.0, value)).over(group) / 10.0, F.lit(1.0e-12))
    checked = _require_benchmark(summary, benchmark, N.SYMBOL)
    shown = checked.withColumns({"_floor": floor,
                                 "_base": _benchmark(metric, benchmark, N.SYMBOL)})
    lifted = F.when(value > 0.0, value).otherwise(F.col("_floor"))
    base = F.when(F.col("_base") > 0.0, F.col("_base")).otherwise(F.col("_floor"))
    order = group.orderBy(metric, "model_name")
    return shown.select(N.SYMBOL, "model_name", value.alias("metric_value"),
                        (lifted / base).alias("ratio_to_benchmark"),
                        F.row_number().over(order).cast("long").alias("rank"))


def top_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """Global top n of a report table: a bounded heap per task, no full sort."""
    return df.orderBy(*order).limit(n)


def ecdf(daily: DataFrame, metric: str) -> DataFrame:
    """Empirical distribution points of each model's daily losses."""
    series = Window.partitionBy(N.SYMBOL, "model_name")
    position = F.row_number().over(series.orderBy(metric, N.DATE, N.TARGET_DATE))
    return daily.select(
        N.SYMBOL, "model_name", F.col(metric).alias("loss_value"),
        position.cast("long").alias("position"),
        (position / F.count(F.lit(1)).over(series)).alias("cumulative_share"))


def ecdf_markers(points: DataFrame) -> DataFrame:
    """Upper median and 95th percentile of each distribution."""
    n = F.count(F.lit(1)).over(Window.partitionBy(N.SYMBOL, "model_name"))
    placed = points.withColumn("n", n)
    median_at = F.floor(F.col("n") / 2).cast("long") + 1
    p95_at = F.least(F.col("n"), F.ceil(F.col("n") * 0.95).cast("long"))
    value = F.col("loss_value")
    return placed.groupBy(N.SYMBOL, "model_name").agg(
        F.max(F.when(F.col("position") == median_at, value)).alias("upper_median"),
        F.max(F.when(F.col("position") == p95_at, value)).alias("p95"),
        F.max("n").alias("n_points"))


def slice_curves(slices: DataFrame, ranked: DataFrame, family: str, scope: str, metric: str,
                 top_models: int = 6) -> DataFrame:
    """Metric along a slice family for the best-ranked models."""
    best = ranked.filter(F.col("rank") <= top_models).select(N.SYMBOL, "model_name")
    chosen = slices.filter((F.col("slice_family") == family)
                           & (F.col("evaluation_scope") == scope))
    return chosen.join(best, [N.SYMBOL, "model_name"], "left_semi").select(
        N.SYMBOL, "model_name", "slice_label", "slice_value_float",
        F.col(metric).alias("metric_value"))


def report_overview(ranked: DataFrame, metric: str, tail: DataFrame, hedging: DataFrame,
                    mcs: DataFrame, leaders: DataFrame, sensitivity: DataFrame,
                    top_slices: int = 5) -> DataFrame:
    """Headline rows per underlying: best loss, tail, hedge, retained set and slice gains."""
    def line(df: DataFrame, item: str, label: Column, value: Column) -> DataFrame:
        return df.select(N.SYMBOL, F.lit(item).alias("item"), label.alias("label"),
                         value.cast("double").alias("value"))

    per_symbol = Window.partitionBy(N.SYMBOL)
    tail_rank = F.row_number().over(per_symbol.orderBy("p95_loss", "max_loss", "mean_loss",
                                                       "model_name"))
    usable = leaders.filter(~F.isnan("improvement_vs_benchmark_pct"))
    gain_rank = F.row_number().over(per_symbol.orderBy(
        F.col("improvement_vs_benchmark_pct").desc(), *SLICE))
    name = F.col("model_name")
    return (
        line(ranked.filter("rank = 1"), "best_loss", name, F.col(metric))
        .unionByName(line(tail.withColumn("_r", tail_rank).filter("_r = 1"), "best_tail", name,
                          F.col("p95_loss")))
        .unionByName(line(hedging.filter("rank = 1"), "best_hedging", name,
                          F.col("mean_abs_revaluation_error")))
        .unionByName(line(mcs.filter("included_in_simplified_tmax_set"), "retained_model", name,
                          F.col("simplified_tmax_alpha")))
        .unionByName(line(
            usable.withColumn("_r", gain_rank).filter(F.col("_r") <= top_slices), "slice_gain",
            F.concat_ws("/", *SLICE, "best_model_name"),
            F.col("improvement_vs_benchmark_pct")))
        .unionByName(line(sensitivity, "completion_mean_rmse", F.lit("all"),
                          F.col("mean_rmse_diff")))
        .unionByName(line(sensitivity, "completion_max_abs", F.lit("all"),
                          F.col("max_max_abs_diff")))
    )
