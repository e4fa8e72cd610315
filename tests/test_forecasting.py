"""Features, splits, forecasts and evaluation on small constructed histories."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions.grid import SurfaceGrid
from optionlake.operators import calendar as cal
from optionlake.operators import contracts, evaluate, features, forecast, report, splits, surface

GRID = SurfaceGrid((30, 90), (-0.1, 0.0))
FIRST = dt.date(2020, 1, 1)


def weekdays(n):
    days, day = [], FIRST
    while len(days) < n:
        if day.weekday() < 5:
            days.append(day)
        day += dt.timedelta(days=1)
    return days


def history(spark, n, symbols=("A",), value=lambda s, t, c: 0.02 + 0.001 * t + 0.0001 * c):
    rows = []
    for s in symbols:
        for t, day in enumerate(weekdays(n)):
            w = [float(value(s, t, c)) for c in range(4)]
            iv = [math.sqrt(x / GRID.maturity_years[c // 2]) for c, x in enumerate(w)]
            mask = [True, True, True, t % 3 != 0]
            rows.append((s, day, f"ts{t:04d}", w, iv, [0.1] * 4,
                         [1.0 + c if m else 0.0 for c, m in enumerate(mask)],
                         [1 if m else 0 for m in mask], mask, w, iv,
                         ["observed" if m else "interpolated" for m in mask]))
    names = ", ".join(f"{a} array<{t}>" for a, t in zip(
        surface.COMPLETED_ARRAYS, ["double"] * 4 + ["long", "boolean", "double", "double",
                                                    "string"]))
    days = spark.createDataFrame(
        rows, f"underlying_symbol string, quote_date date, {N.DECISION_TS} string, {names}")
    return GRID.with_ids(days, "cfg")


@pytest.fixture(scope="module")
def lookup(spark):
    a, b = dt.date(2019, 12, 1), dt.date(2023, 12, 31)
    return cal.session_lookup(cal.session_table(cal.weekday_sessions(spark, a, b)), a, b)


def test_features_lag_change_and_target(spark, lookup):
    gold = history(spark, 30)
    settings = features.FeatureSettings()
    built = features.build_features(gold, GRID, lookup, settings).orderBy("quote_date").collect()
    days = weekdays(30)
    assert [r.quote_date for r in built] == days[21:29]
    row = built[0]
    w = lambda t: 0.02 + 0.001 * t
    assert row.target_date == days[22]
    assert row.feature_surface_mean_01[0] == pytest.approx(w(21))
    assert row.feature_surface_mean_05[0] == pytest.approx(np.mean([w(t) for t in range(17, 22)]))
    assert row.feature_surface_mean_22[0] == pytest.approx(np.mean([w(t) for t in range(22)]))
    assert row.feature_surface_change_01 == pytest.approx([0.001] * 4)
    assert row.feature_mask_mean_22[3] == pytest.approx(14 / 22)
    assert row.target_total_variance[0] == pytest.approx(w(22))
    assert row.target_training_weight == [1.0, 2.0, 3.0, 4.0]
    assert built[2].target_training_weight == [1.0, 2.0, 3.0, 1.0]
    assert row.feature_coverage_ratio == 0.75 and row.target_gap_sessions == 0


def test_three_dates_give_the_middle_row(spark):
    settings = features.FeatureSettings(lag_windows=(1,))
    rows = features.feature_cells(history(spark, 3), GRID, settings)
    assert {r.quote_date for r in rows.collect()} == {weekdays(3)[1]}
    short = contracts.check_min_history(history(spark, 2), 3).collect()
    assert short[0].n_dates == 2


def test_widened_layout_and_roles(spark, lookup):
    wide = features.widen_features(features.build_features(history(spark, 25), GRID, lookup), GRID)
    features.check_feature_layout(wide.columns, GRID)
    with pytest.raises(ValueError):
        features.check_feature_layout(wide.columns[::-1], GRID)
    roles = {r.column_name: r.role for r in features.column_roles(wide).collect()}
    assert roles["feature_mask_mean_05_0003"] == "model_feature"
    assert roles["target_vega_weight_0000"] == "target_weight"
    with pytest.raises(ValueError, match="no declared availability"):
        features.role_of_column("surprise")
    late = contracts.leakage_check(wide).filter("n_rows > 0")
    assert late.count() == 0
    swapped = wide.withColumn(N.TARGET_TS, F.col(N.DECISION_TS))
    assert contracts.leakage_check(swapped).filter("n_rows > 0").count() == 16


def test_leakage_follows_lag_windows(spark, lookup):
    """A surface revised five days later leaks into the features whose window reaches it."""
    gold = history(spark, 30).withColumn(N.DECISION_TS, F.date_format(N.DATE, "yyyy-MM-dd'T'00:00:00"))
    days = weekdays(30)
    made = features.build_features(gold, GRID, lookup)
    on_time = features.feature_lineage(gold)
    assert contracts.leakage_check(made, on_time).filter("n_rows > 0").count() == 0
    revised = gold.withColumn("known_at", F.to_timestamp(N.DECISION_TS) + F.when(
        F.col(N.DATE) == days[24], F.expr("interval 60 hours")).otherwise(F.expr("interval 0 hours")))
    late = {r.column_name: r.n_rows for r in contracts.leakage_check(
        made, features.feature_lineage(revised, "known_at")).collect()}
    known = dt.datetime.combine(days[24], dt.time()) + dt.timedelta(hours=60)
    used = {1: days[24:25], 2: days[24:26], 5: days[24:29], 22: days[24:]}
    want = {n: sum(dt.datetime.combine(d, dt.time()) < known for d in ds) for n, ds in used.items()}
    assert [late[f"feature_surface_mean_{n:02d}"] for n in (1, 5, 22)] == [want[n] for n in (1, 5, 22)]
    assert late["feature_surface_change_01"] == want[2] and late["feature_mask_mean_01"] == want[1]
    assert late["target_total_variance"] == 0 and want[1] == 1
    missing = features.feature_lineage(gold.filter(F.col(N.DATE) != days[24]))
    assert contracts.leakage_check(made, missing).filter("n_rows > 0").count() > 0


def test_training_weight_contract(spark):
    def weights(mask, vega):
        df = spark.createDataFrame([(mask, vega)], "m double, v double")
        return df.select(features.training_weight(F.col("m"), F.col("v")).alias("w")).first().w

    assert weights(1.0, 2.0) == 2.0 and weights(0.0, 0.0) == 1.0
    for mask, vega in ((0.5, 1.0), (1.0, 0.0), (1.0, -1.0), (0.0, math.nan), (None, 1.0)):
        with pytest.raises(Exception, match="target"):
            weights(mask, vega)


def brute_splits(n, wf):
    start, number = wf.train_size + wf.validation_size, 0
    while start + wf.test_size <= n:
        v = start - wf.validation_size
        t0 = 0 if wf.expanding_train else max(0, v - wf.train_size)
        for role, a, b in (("train", t0, v), ("validation", v, start),
                           ("test", start, start + wf.test_size)):
            yield from ((number, role, i) for i in range(a, b))
        number += 1
        start += wf.step_size


@pytest.mark.parametrize("sizes", [(10, 4, 3, 3, True), (10, 4, 3, 2, False), (5, 2, 4, 7, True),
                                   (7, 3, 5, 1, False)])
def test_splits_equal_a_direct_walk(spark, sizes):
    wf = splits.WalkforwardSettings(*sizes)
    days = weekdays(40)
    frame = spark.createDataFrame(
        [("A", d) for d in days] + [("B", d) for d in days[:9]],
        "underlying_symbol string, quote_date date")
    rows = splits.walkforward_splits(frame, wf)
    found = {(r.split_no, r.role, days.index(r.quote_date))
             for r in rows.filter("underlying_symbol = 'A'").collect()}
    assert found == set(brute_splits(40, wf))
    assert splits.check_splits(rows, frame, wf).count() == 0


def test_first_clean_split(spark):
    wf = splits.WalkforwardSettings(504, 126, 21, 21)
    days = weekdays(714)
    frame = spark.createDataFrame([("A", d) for d in days],
                                  "underlying_symbol string, quote_date date")
    rows = splits.walkforward_splits(frame, wf)
    row = splits.clean_boundary(rows, 3).collect()[0]
    assert row.first_clean_test_split_id == "split_0002"
    assert row.max_hpo_validation_date == days[504 + 126 + 42 - 1]
    clean = {r.split_id for r in splits.clean_splits(rows, 3).select("split_id").collect()}
    assert clean == {"split_0002", "split_0003"}


@pytest.fixture(scope="module")
def case(spark, lookup):
    rng = np.random.default_rng(3)
    noise = rng.uniform(0.9, 1.1, size=(2, 90, 4))
    gold = history(spark, 90, ("A", "B"),
                   lambda s, t, c: 0.03 * (1 + c // 2) * noise["AB".index(s), t, c]).cache()
    feats = features.build_features(gold, GRID, lookup).cache()
    wf = splits.WalkforwardSettings(30, 10, 5, 5)
    return gold, feats, wf, splits.walkforward_splits(feats, wf).cache()


def test_projected_and_fitted_forecasts_cover_the_same_dates(spark, case):
    gold, feats, wf, rows = case
    tested = splits.clean_splits(rows, 2).filter("role = 'test'")
    boundary = splits.clean_boundary(rows, 2)
    plans = [forecast.FitPlan("ridge", {"alpha": 1.0}),
             forecast.FitPlan("har_factor", {"n_factors": 2, "alpha": 1.0}),
             forecast.FitPlan("elasticnet", {"alpha": 0.1, "l1_ratio": 0.5})]
    flat = forecast.project_forecasts(feats, tested, "r")
    fitted = forecast.fit_forecasts(feats, boundary, plans, wf, GRID, "r", split_buckets=3)
    both = flat.unionByName(fitted).cache()
    assert both.groupBy("model_name").count().select("count").distinct().count() == 1
    long = forecast.write_forecasts_long(both, GRID)
    assert evaluate.assert_equal_coverage(long).count() == 0
    assert evaluate.assert_after_boundary(both, boundary).count() == 0
    panel = evaluate.realization_panel(both, gold, GRID)
    assert panel.count() == long.count()
    daily = evaluate.daily_loss(panel)
    assert daily.select("model_name").distinct().count() == 6
    again = forecast.fit_forecasts(feats, boundary, plans[:1], wf, GRID, "r", split_buckets=1)
    one = {(r[0], r[1]): r[2] for r in again.select(*N.DAY, "predictions").collect()}
    two = {(r[0], r[1]): r[2] for r in fitted.filter("model_name = 'ridge'").select(
        *N.DAY, "predictions").collect()}
    assert one.keys() == two.keys()
    assert all(one[k] == pytest.approx(two[k]) for k in one)


def test_ridge_fit_uses_train_and_validation_rows_only(spark, case):
    gold, feats, wf, rows = case
    from optionlake.operators import learners
    boundary = splits.clean_boundary(rows, 2)
    made = forecast.fit_forecasts(feats, boundary, [forecast.FitPlan("ridge", {"alpha": 2.0})],
                                  wf, GRID, "r")
    data = sorted(forecast.training_rows(feats, features.FeatureSettings()).filter(
        "underlying_symbol = 'A'").collect(), key=lambda r: r.position)
    x, y = np.array([r.x for r in data]), np.array([r.log_y for r in data])
    split = 4
    end = wf.train_size + wf.validation_size + split * wf.step_size
    expected = np.exp(learners.ridge(x[:end], None, y[:end], x[end:end + 5], None, 4, 2.0)[0])
    got = sorted(made.filter("underlying_symbol = 'A' and split_id = 'split_0004'").collect(),
                 key=lambda r: r.quote_date)
    assert [r.quote_date for r in got] == [r.quote_date for r in data[end:end + 5]]
    assert np.array([r.predictions for r in got]) == pytest.approx(expected)


def test_sweep_prefers_the_set_that_reproduces_the_targets(spark, case):
    _, feats, wf, _ = case
    plans = [forecast.FitPlan("ridge", {"alpha": a}) for a in (1e6, 10.0)]
    validation = forecast.validation_forecasts(feats, plans, wf, 2, GRID)
    assert validation.groupBy("underlying_symbol", "params_id").count().filter(
        "count <> 20").count() == 0
    truth = validation.join(feats.select(*N.DAY, "target_total_variance"), list(N.DAY)).withColumn(
        "predictions", F.when(F.col("params_id").contains("10.0"), F.col("target_total_variance"))
        .otherwise(F.col("predictions"))).drop("target_total_variance")
    best = forecast.validation_sweep(forecast.sweep_scores(truth, feats)).collect()
    assert {r.best_params for r in best} == {'{"alpha":10.0}'}
    assert all(r.best_score == 0.0 and r.n_params == 2 for r in best)


def test_perfect_forecast_has_no_loss(spark, case):
    gold, feats, _, rows = case
    tested = rows.filter("role = 'test'")
    perfect = forecast.project_forecasts(feats, tested, "r", {"oracle": "target_total_variance"})
    losses = evaluate.daily_loss(evaluate.realization_panel(perfect, gold, GRID)).collect()
    for r in losses:
        for scope in ("observed", "full"):
            for m in evaluate.METRICS:
                assert abs(r[f"{scope}_{m}"]) < 1e-12


def test_negative_and_missing_predictions_raise(spark, case):
    gold, feats, _, rows = case
    tested = rows.filter("role = 'test'")
    spoiled = feats.withColumn("feature_surface_mean_01", F.transform(
        "feature_surface_mean_01", lambda v: -v))
    with pytest.raises(Exception, match="finite and non-negative"):
        forecast.project_forecasts(spoiled, tested, "r").collect()
    made = forecast.project_forecasts(feats, tested, "r")
    with pytest.raises(Exception, match="without a realised"):
        evaluate.realization_panel(made, gold.filter("underlying_symbol = 'A'"), GRID).collect()
    counts = {r.check_name: r.n_rows for r in evaluate.panel_mismatches(evaluate.matched_days(
        made, gold.filter("underlying_symbol = 'A'"))).collect()}
    assert counts["actual_surface"] == made.filter("underlying_symbol = 'B'").count() > 0


PANEL = ("underlying_symbol string, model_name string, quote_date date, target_date date, "
         "maturity_days long, moneyness_point double, actual_observed_mask boolean, "
         "observed_weight double, actual_completed_total_variance double, "
         "predicted_total_variance double, actual_completed_iv double, predicted_iv double, "
         "actual_iv_change double, predicted_iv_change double, actual_completion_status string")


def eval_panel(spark):
    rows = []
    for m, bias in (("naive", 0.02), ("good", 0.001)):
        for d in (4, 5):
            for t in (30, 90):
                for k in (-0.1, 0.0):
                    seen = not (d == 5 and t == 90 and k == 0.0)
                    w = 0.05
                    rows.append(("A", m, dt.date(2021, 1, d), dt.date(2021, 1, d + 1), t, k, seen,
                                 1.0 if seen else 0.0, w, w + bias, 0.2, 0.2 + bias, 0.01,
                                 0.01 + bias, "observed" if seen else "interpolated"))
    return spark.createDataFrame(rows, PANEL)


def test_slices_and_leaders(spark):
    window = [("stress", dt.date(2021, 1, 5), dt.date(2021, 1, 6)),
              ("empty", dt.date(1999, 1, 1), dt.date(1999, 1, 2))]
    panel = eval_panel(spark)
    slices = evaluate.slice_metrics(panel, window).cache()
    assert slices.count() == 20
    stress = slices.filter("slice_family = 'stress_window' and evaluation_scope = 'observed'")
    assert {(r.cell_count, r.target_day_count) for r in stress.collect()} == {(7, 2)}
    blind = evaluate.slice_metrics(panel.withColumns({
        "actual_observed_mask": F.col("moneyness_point") < 0.0,
        "observed_weight": F.when(F.col("moneyness_point") < 0.0, 1.0).otherwise(0.0)}), [])
    empty = blind.filter("slice_label = '+0.00' and evaluation_scope = 'observed'").collect()
    assert all(math.isnan(r.wrmse_iv) and (r.cell_count, r.target_day_count) == (0, 0)
               for r in empty) and len(empty) == 2
    best = report.slice_leaders(slices, "wrmse_total_variance", "naive").collect()
    assert {r.best_model_name for r in best} == {"good"}
    assert all(r.improvement_vs_benchmark_pct == pytest.approx(95.0) for r in best)
    with pytest.raises(Exception, match="benchmark model"):
        report.slice_leaders(slices.filter("model_name = 'good'"), "wmae_iv", "naive").collect()


def test_cell_leaders_break_ties_by_name(spark):
    tied = eval_panel(spark).withColumn("predicted_total_variance", F.lit(0.06))
    assert {r.best_model_name for r in report.cell_leaders(tied, "naive").collect()} == {"good"}
    best = report.cell_leaders(eval_panel(spark), "naive").collect()
    assert all(r.improvement_vs_benchmark_pct > 0 for r in best) and len(best) == 4


def test_weighted_metrics(spark):
    rows = [("A", "m", dt.date(2021, 1, 4), dt.date(2021, 1, 5), 30, k, True, w, y, p, 0.2, 0.2,
             0.0, 0.0, "observed") for k, w, y, p in
            ((0.0, 1.0, 1.0, 2.0), (0.1, 2.0, 3.0, 1.0), (0.2, 1.0, 5.0, 6.0))]
    row = evaluate.daily_loss(spark.createDataFrame(rows, PANEL)).collect()[0]
    assert row.observed_mse_total_variance == pytest.approx(2.5)
    assert row.observed_wmae_total_variance == pytest.approx(1.5)
    assert row.full_mse_total_variance == pytest.approx(2.0)
    blank = spark.createDataFrame(rows, PANEL).withColumn("observed_weight", F.lit(0.0))
    with pytest.raises(Exception, match="no positive observed weight"):
        evaluate.daily_loss(blank).collect()
    assert contracts.check_mask_weights(blank, evaluate.DAY_KEY).collect()[0].n_unweighted == 3


def test_sweep_policy(spark):
    schema = ("underlying_symbol string, n_splits int, max_hpo_validation_date date, "
              "first_clean_test_split_id string, loss_metric string")
    d = dt.date(2021, 1, 4)
    same = spark.createDataFrame([("A", 3, d, "split_0002", "mse")] * 2, schema)
    assert forecast.check_sweep_policy(same).count() == 0
    mixed = spark.createDataFrame([("A", 3, d, "split_0002", "mse"),
                                   ("A", 2, d, "split_0002", "mse")], schema)
    assert forecast.check_sweep_policy(mixed).count() == 1


def test_pooled_learner_predicts_every_test_date(spark, case):
    _, feats, wf, rows = case
    from optionlake.operators import pooled
    made = pooled.pooled_forecasts(feats, rows, "pooled_ridge", "r", {"alpha": 0.01}, 2, [0, 1])
    expected = rows.filter("role = 'test' and split_no < 2").count()
    assert made.count() == expected
    assert all(min(r.predictions) > 0 for r in made.collect())
