"""Comparison tests, hedging, report tables and streaming."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions.grid import SurfaceGrid, SurfaceSettings
from optionlake.operators import compare, hedge, report, shape
from optionlake.streaming import jobs

D = dt.date
LOSS = "underlying_symbol string, loss_metric string, model_name string, target_date date, loss double"


def losses(spark, **series):
    rows = [("A", "mse", m, D(2021, 1, 1) + dt.timedelta(days=i), float(v))
            for m, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, LOSS)


def test_constant_advantage_is_infinitely_significant(spark):
    row = compare.diebold_mariano(losses(spark, naive=[2] * 4, good=[1] * 4), "naive").collect()[0]
    assert (row.mean_differential, row.statistic, row.p_value) == (1.0, math.inf, 0.0)
    row = compare.diebold_mariano(losses(spark, naive=[1] * 4, same=[1] * 4), "naive",
                                  "two-sided").collect()[0]
    assert (row.statistic, row.p_value) == (0.0, pytest.approx(1.0))
    row = compare.diebold_mariano(losses(spark, naive=[1] * 4, bad=[2] * 4), "naive",
                                  "less").collect()[0]
    assert (row.statistic, row.p_value) == (-math.inf, 0.0)


@pytest.mark.parametrize("alternative", ["two-sided", "greater", "less"])
def test_dm_equals_direct_computation(spark, alternative):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(size=30), rng.uniform(size=30)
    row = compare.diebold_mariano(losses(spark, naive=a, other=b), "naive", alternative,
                                  3).collect()[0]
    d = a - b
    c = d - d.mean()
    lrv = c @ c / 30 + sum(2 * (1 - k / 4) * (c[k:] @ c[:-k]) / 30 for k in (1, 2, 3))
    z = d.mean() / math.sqrt(max(lrv, 0.0) / 30)
    cdf = lambda v: 0.5 * math.erfc(-v / math.sqrt(2))
    p = {"two-sided": 2 * (1 - cdf(abs(z))), "greater": 1 - cdf(z), "less": cdf(z)}[alternative]
    assert row.statistic == pytest.approx(z) and row.p_value == pytest.approx(p, abs=1e-12)


SIX = {"naive": [1.0, 1.1, 0.9, 1.2, 1.0, 1.1], "good": [0.4, 0.5, 0.4, 0.5, 0.4, 0.5],
       "bad": [2.0, 2.1, 2.2, 2.0, 2.1, 2.3]}


@pytest.mark.parametrize("source", ["hash", "numpy"])
def test_spa_and_model_set(spark, source):
    series = compare.loss_series(losses(spark, **SIX))
    spa = compare.spa_test(series, "naive", block=2, reps=200, seed=7, source=source).collect()[0]
    assert spa.superior_models_by_mean == ["good"] and 0.0 <= spa.p_value <= 1.0
    assert spa.candidate_models == ["bad", "good"]
    found = compare.model_confidence_set(series, 0.10, 2, 200, 7, source).collect()[0]
    assert "bad" not in found.superior_models and "good" in found.superior_models
    first = found.iterations[0]
    assert first.eliminated_model == "bad" and first.included_models == ["good", "naive"]
    table = report.mcs_table(
        compare.model_confidence_set(series, 0.10, 2, 200, 7, source),
        losses(spark, **SIX).select("underlying_symbol", "model_name")).collect()
    assert {r.model_name: r.included_in_simplified_tmax_set for r in table}["bad"] is False
    assert report.spa_table(compare.spa_test(series, "naive", block=2, reps=50)).collect()[0] \
        .candidate_models == "bad,good"


def test_generator_source_matches_the_public_stream():
    rng = np.random.default_rng(7)
    expected = np.stack([rng.integers(0, 6, size=3) for _ in range(4)])
    assert (compare.generator_starts(6, 3, 4, 7) == expected).all()


def test_unequal_series_raise_and_are_listed(spark):
    uneven = losses(spark, naive=[1, 2, 3], good=[1, 2])
    with pytest.raises(Exception, match="differ in length"):
        compare.loss_series(uneven).collect()
    wide = uneven.withColumnRenamed("loss", "m")
    bad = compare.loss_matrix_violations(wide, "m").collect()
    assert [r.target_date for r in bad] == [D(2021, 1, 3)]


GRID = SurfaceGrid((1, 30, 90), (-0.3, -0.1, 0.0, 0.1, 0.3))


def flat(sigma):
    return [sigma * sigma * d / 365.0 for d in GRID.maturity_days for _ in GRID.moneyness_points]


def trade(spark, predicted, actual_t, actual_t1, spot_t=100.0, spot_t1=100.0):
    return spark.createDataFrame(
        [("A", "m", D(2021, 1, 4), D(2021, 1, 5), predicted, spot_t, actual_t, spot_t1, actual_t1)],
        "underlying_symbol string, model_name string, quote_date date, target_date date, "
        "predicted array<double>, spot_t double, actual_t array<double>, spot_t1 double, "
        "actual_t1 array<double>")


def test_perfect_prediction_has_no_revaluation_error(spark):
    row = hedge.evaluate_hedging(trade(spark, flat(0.25), flat(0.2), flat(0.25), 100.0, 101.0),
                                 GRID).collect()[0]
    assert abs(row.revaluation_error) < 1e-10
    assert abs(row.predicted_net_delta) < 1e-8 and abs(row.predicted_net_vega) < 1e-8
    assert row.hedge_status == "ok"
    check = (row.unhedged_pnl, row.hedged_pnl)
    assert all(math.isfinite(v) for v in check)


def bs(spot, strike, tau, sigma, kind):
    cdf = lambda v: 0.5 * math.erfc(-v / math.sqrt(2))
    d1 = (math.log(spot / strike) + 0.5 * sigma * sigma * tau) / (sigma * math.sqrt(tau))
    d2 = d1 - sigma * math.sqrt(tau)
    if kind == "C":
        return spot * cdf(d1) - strike * cdf(d2)
    return strike * cdf(-d2) - spot * cdf(-d1)


def test_book_value_on_a_flat_surface(spark):
    settings = hedge.HedgeSettings()
    valued = hedge.value_instruments(trade(spark, flat(0.3), flat(0.2), flat(0.25), 100.0, 102.0),
                                     GRID, settings).cache()
    expected = sum(q * bs(100.0, 100.0 * math.exp(s), d / 365, 0.2, k)
                   for _, k, q, s, d in settings.book())
    books = {r.state: r for r in hedge.value_book(valued).collect()}
    assert books[hedge.NOW].total_value == pytest.approx(expected)
    later = sum(q * bs(102.0, 100.0 * math.exp(s), (d - 1) / 365, 0.3, k)
                for _, k, q, s, d in settings.book())
    # Between grid maturities flat volatility gives flat volatility: variance is linear in days.
    assert books[hedge.PREDICTED].total_value == pytest.approx(later)
    assert valued.filter("is_hedge and state = 't1_predicted'").count() == 0


def test_infeasible_hedge(spark):
    trades = trade(spark, [0.0] * 15, flat(0.2), flat(0.2))
    with pytest.raises(Exception, match="infeasible"):
        hedge.evaluate_hedging(trades, GRID).collect()
    row = hedge.evaluate_hedging(trades, GRID, strict=False).collect()[0]
    assert row.hedge_status == "infeasible" and row.hedged_pnl is None


def test_surface_domain(spark):
    def sigma(days, m, strict=True):
        df = spark.createDataFrame([(flat(0.2), days, m)], "s array<double>, d int, m double")
        return hedge.add_sigma(df, "s", "d", "m", GRID, strict).collect()[0].sigma

    assert sigma(30, 0.0) == pytest.approx(0.2)
    assert sigma(60, 0.2) == pytest.approx(0.2)
    assert sigma(90, math.log(math.exp(0.3)) + 1e-13) == pytest.approx(0.2)
    assert sigma(30, -0.3 - 5e-13) == pytest.approx(0.2)
    for days, m in ((0, 0.0), (30, 0.5), (91, 0.0)):
        with pytest.raises(Exception, match="outside the surface domain"):
            sigma(days, m)
        assert sigma(days, m, strict=False) is None


def test_intrinsic_value_when_nothing_is_left(spark):
    rows = spark.createDataFrame(
        [(100.0, 90.0, 0.0, 0.2, "C"), (100.0, 110.0, 0.1, 0.0, "P"), (100.0, 110.0, 0.0, 0.2, "C")],
        "spot double, strike double, tau_years double, sigma double, option_type string")
    got = [(r.price, r.delta, r.vega) for r in hedge.add_black_scholes(rows).collect()]
    assert got == [(10.0, 1.0, 0.0), (10.0, -1.0, 0.0), (0.0, 0.0, 0.0)]


def test_hedge_config_and_summary_checks(spark):
    hedge.check_hedge_config(hedge.HedgeSettings(), GRID, 4)
    with pytest.raises(ValueError, match="leaves the grid"):
        hedge.check_hedge_config(hedge.HedgeSettings(), GRID, 30)
    with pytest.raises(ValueError, match="positive"):
        hedge.check_hedge_config(hedge.HedgeSettings(), GRID, 0)
    results = hedge.evaluate_hedging(trade(spark, flat(0.25), flat(0.2), flat(0.25)), GRID)
    summary = hedge.hedging_summary(results)
    assert hedge.check_hedge_summary(summary, results).count() == 0
    wrong = summary.withColumn("mean_abs_hedged_pnl", F.col("mean_abs_hedged_pnl") + 1)
    assert hedge.check_hedge_summary(wrong, results).count() == 1


def shape_of(spark, values, grid):
    df = spark.createDataFrame([("A", [float(v) for v in values])], "k string, w array<double>")
    return shape.shape_diagnostics(df, "w", grid, ("k",)).collect()[0]


def test_shape_vectors(spark):
    calm = shape_of(spark, [0.04] * 4, SurfaceGrid((30,), (-0.3, -0.1, -0.05, 0.3)))
    assert (calm.convexity_violation_count, calm.calendar_violation_count) == (0, 0)
    spike = shape_of(spark, [0.01, 1.0, 0.01], SurfaceGrid((30,), (-0.1, 0.0, 0.1)))
    assert spike.convexity_violation_count > 0 and spike.convexity_violation_magnitude > 0
    fall = shape_of(spark, [0.04, 0.05, 0.01, 0.06], SurfaceGrid((30, 60), (0.0, 0.1)))
    assert fall.calendar_violation_count == 1
    assert fall.calendar_violation_magnitude == pytest.approx(0.03)
    with pytest.raises(Exception, match="positive total variance"):
        shape_of(spark, [0.0, 0.1, 0.1], SurfaceGrid((30,), (-0.1, 0.0, 0.1)))


def test_well_shaped_surface_has_no_penalty(spark):
    grid = SurfaceGrid((30, 60, 90), (-0.1, 0.0, 0.1))
    df = spark.createDataFrame([("A", [0.01, 0.01, 0.01, 0.02, 0.02, 0.02, 0.03, 0.03, 0.03])],
                               "k string, w array<double>")
    row = shape.shape_penalties(df, "w", grid, ("k",)).collect()[0]
    assert (row.calendar_penalty, row.convexity_penalty) == (0.0, 0.0)
    assert row.roughness_penalty == pytest.approx(0.0, abs=1e-30)
    with pytest.raises(ValueError):
        shape.shape_penalties(df, "w", SurfaceGrid((30, 60), (0.0, 0.1)), ("k",))


def test_report_tables(spark):
    summary = spark.createDataFrame(
        [("A", "naive", 2.0, 0.1, 5), ("A", "good", 1.0, 0.1, 5), ("A", "zero", 0.0, 0.0, 5)],
        "underlying_symbol string, model_name string, mean_x double, std_x double, n_target_dates long")
    ranked = report.ranked_loss(summary, "mean_x", "naive").orderBy("rank").collect()
    assert [(r.rank, r.model_name, r.improvement_vs_benchmark_pct) for r in ranked] == [
        (1, "zero", 100.0), (2, "good", 50.0), (3, "naive", 0.0)]
    ratio = {r.model_name: r.ratio_to_benchmark for r in
             report.relative_ranking(summary, "mean_x", "naive").collect()}
    assert ratio == {"naive": 1.0, "good": 0.5, "zero": pytest.approx(0.05)}
    nothing = report.ranked_loss(summary, "mean_x", "zero").collect()
    assert all(r.improvement_vs_benchmark_pct is None for r in nothing)
    with pytest.raises(Exception, match="benchmark model"):
        report.ranked_loss(summary, "mean_x", "absent").collect()


def test_nearest_rank_quantiles(spark):
    daily = spark.createDataFrame(
        [("A", "naive", D(2021, 1, 1) + dt.timedelta(days=i), D(2021, 1, 2) + dt.timedelta(days=i),
          float(i)) for i in range(10)],
        "underlying_symbol string, model_name string, quote_date date, target_date date, loss double")
    row = report.tail_risk(daily, "loss", "naive").collect()[0]
    assert (row.p90_loss, row.p95_loss, row.p99_loss, row.max_loss) == (8.0, 9.0, 9.0, 9.0)
    marks = report.ecdf_markers(report.ecdf(daily, "loss")).collect()[0]
    assert (marks.upper_median, marks.p95, marks.n_points) == (5.0, 9.0, 10)
    worst = report.worst_days(daily, "loss", "naive", 2).collect()
    assert sorted((r.rank_within_model, r.loss_value) for r in worst) == [(1, 9.0), (2, 8.0)]


def test_streamed_surface_closes_days_and_drops_late_rows(spark, folder):
    settings = SurfaceSettings(SurfaceGrid((30,), (0.0,)))
    schema = ("underlying_symbol string, decision_ts timestamp, maturity_index long, "
              "moneyness_index long, total_variance double, vega_1545 double, "
              "inside_grid_domain boolean")
    source, out, mark = (f"{folder}/{n}" for n in ("in", "out", "mark"))

    def arrive(day, *pairs):
        rows = [("A", dt.datetime(2021, 1, day, 20, 45), 0, 0, w, v, True) for w, v in pairs]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(source)
        query = jobs.stream_observed_surface(stream, settings).writeStream.outputMode(
            "append").format("parquet").option("path", out).option(
            "checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    arrive(4, (0.04, 1.0), (0.09, 3.0))
    arrive(8, (0.01, 1.0))
    late = arrive(4, (9.0, 9.0))
    arrive(12, (0.02, 1.0))
    dropped = sum(op["numRowsDroppedByWatermark"] for p in late.recentProgress
                  for op in p["stateOperators"])
    rows = {r.quote_date: r for r in spark.read.parquet(out).collect()}
    assert rows[D(2021, 1, 4)].observed_total_variance == pytest.approx(0.0775)
    assert rows[D(2021, 1, 4)].observation_count == 2 and dropped == 1
    # the last day is inside the watermark; its state and the late row are accounted for
    still = jobs.open_days(spark, mark)
    last, = still.filter("quote_date = date'2021-01-12'").collect()
    assert (last.observed_total_variance, last.observation_count) == (pytest.approx(0.02), 1)
    surface = spark.read.parquet(out).unionByName(still)
    assert sorted(r.quote_date.day for r in surface.collect()) == [4, 8, 12]
    counts = jobs.late_counts(spark.read.parquet(source), surface).collect()
    assert [(r.quote_date.day, r.n_arrived, r.n_counted, r.n_late) for r in counts] == [(4, 3, 2, 1)]
