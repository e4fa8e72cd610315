"""Seeded breaches stop the run in the write that makes them; whole tables pass."""

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks import view
from checks.queries import SETTINGS
from optionlake import names as N
from optionlake.operators import compare, evaluate, forecast, gate, hedge, panel
from optionlake.operators.contracts import ContractError
from optionlake.plans.pipeline import GATES, Run
from optionlake.sources.stages import StageTables

SMALL = "/root/testdata/sf0.001"
ALL = dataclasses.replace(SETTINGS, gates=GATES, symbols=("AAA",))


def clean_quotes(spark):
    return view.raw_quotes(spark, SMALL).filter("option_type is not null and underlying_symbol = 'AAA'")


@pytest.fixture(scope="module")
def run(spark):
    done = Run(lambda: clean_quotes(spark), ALL, StageTables(spark))
    done.hedging()
    return done


@pytest.fixture()
def again(run, monkeypatch):
    """Forget a stage of the finished run and break what builds it; it is rebuilt afterwards."""
    stages = []

    def broken(stage, module, name, change):
        stages.append(stage)
        run.tables._written.discard(stage)
        original = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: change(original(*a, **k)))

    yield broken
    run.tables._written -= set(stages)


def test_clean_run_passes_every_gate(run):
    assert run.daily_loss().count() > 0 and run.ingest().filter("status <> 'written'").isEmpty()
    assert {"bronze", "ingest", "silver", "forecasts", "daily_loss", "hedging"} <= set(run.tables.observed)


@pytest.mark.parametrize("change, what", [
    (lambda q: q.withColumn("option_type", F.when(F.col("trade_volume") != 7, F.col("option_type"))),
     "option_type is null"),
    (lambda q: q.withColumn("underlying_symbol", F.when(
        F.col("trade_volume") == 7, "CCC").otherwise(F.col("underlying_symbol"))), "foreign underlying"),
    (lambda q: q.withColumn("source_zip", F.substring("source_zip", 1, 33)), "several_quote_dates"),
])
def test_bad_files_stop_the_ingest(spark, change, what):
    bad = Run(lambda: change(clean_quotes(spark)), ALL, StageTables(spark))
    with pytest.raises(ContractError, match=what):
        bad.silver()


def test_dates_outside_the_window_stop_the_ingest(spark):
    late = dataclasses.replace(ALL, sample_window=(dt.date(1996, 1, 1), dt.date(2000, 12, 31)))
    with pytest.raises(ContractError, match="outside the window"):
        Run(lambda: clean_quotes(spark), late, StageTables(spark)).bronze()


def test_unusable_inputs_stop_the_panel(run, again):
    again("silver", panel, "flag_quality", lambda p: p.withColumn("is_valid_observation", F.lit(True)))
    with pytest.raises(ContractError, match="unusable input"):
        run.silver()


@pytest.mark.parametrize("change", [
    lambda f: f.filter("not (model_name = 'mean5' and dayofmonth(quote_date) = 15)"),
    lambda f: f.union(f.filter("model_name = 'naive' and dayofmonth(quote_date) = 15")),
    lambda f: f.withColumn("quote_date", F.when(
        (F.col("model_name") == "naive") & (F.dayofmonth("quote_date") == 15),
        F.date_add("quote_date", 400)).otherwise(F.col("quote_date"))),
])
def test_unequal_coverage_stops_the_forecasts(run, again, change):
    again("forecasts", forecast, "project_forecasts", change)
    with pytest.raises(ContractError, match="keys differ between naive"):
        run.forecasts()


def test_identity_mismatch_stops_the_panel(run):
    for column, value in (("surface_grid_hash", F.lit("other")),
                          (N.TARGET_TS, F.col(N.TARGET_TS) + F.expr("interval 1 second"))):
        other = run.forecasts().withColumn(column, F.when(
            F.dayofmonth("quote_date") == 15, value).otherwise(F.col(column)))
        with pytest.raises(Exception, match="forecast differs from its surfaces"):
            evaluate.realization_panel(other, run.gold(), run.grid).count()
            evaluate.daily_loss(evaluate.realization_panel(other, run.gold(), run.grid)).collect()


@pytest.mark.parametrize("change, what", [
    (lambda d: d.withColumn("observed_mse_total_variance", F.when(
        F.dayofmonth("target_date") != 15, F.col("observed_mse_total_variance")).otherwise(
            F.lit(float("nan")))), "not finite"),
    (lambda d: d.filter("not (model_name = 'mean5' and dayofmonth(target_date) = 15)"), "keys differ"),
])
def test_broken_losses_stop_the_run(run, again, change, what):
    again("daily_loss", evaluate, "daily_loss", change)
    with pytest.raises(ContractError, match=what):
        run.daily_loss()


def test_missing_hedges_stop_the_run(run, again):
    again("hedging", hedge, "evaluate_hedging", lambda h: h.filter("dayofmonth(quote_date) <> 15"))
    with pytest.raises(ContractError, match="keys of trades differ"):
        run.hedging()


def test_a_broken_stage_is_not_kept(spark):
    tables, rules = StageTables(spark), gate.Gate("t", {"small": F.col("id") < 3})
    with pytest.raises(ContractError, match="small: 3 rows"):
        tables.get("t", lambda: spark.range(9), lambda: rules)
    assert tables.get("t", lambda: spark.range(3, 9), lambda: rules).count() == 6
    assert tables.get("none", lambda: spark.range(0), lambda: rules).count() == 0


def test_days_without_a_benchmark_loss_raise(run):
    daily = run.daily_loss().filter("not (model_name = 'naive' and dayofmonth(target_date) = 15)")
    with pytest.raises(Exception, match="no benchmark loss"):
        evaluate.day_win_counts(daily, SETTINGS.loss_metrics[0], "naive").collect()


LOSS = "underlying_symbol string, loss_metric string, model_name string, target_date date, loss double"


def table(spark, **models):
    return spark.createDataFrame(
        [("A", "m", name, dt.date(2024, 1, 1) + dt.timedelta(days=at), float(x))
         for name, values in models.items() for at, x in values], LOSS)


@pytest.mark.parametrize("models, lag, what", [
    (dict(naive=enumerate([1] * 10), c=enumerate([2] * 4)), 0, "differ in length"),
    (dict(naive=[(0, 1), (1, 2)], c=[(0, 1), (2, 2)]), 0, "differ in dates"),
    (dict(naive=enumerate([1, 2, 3]), c=enumerate([1, float("nan"), 3])), 0, "NULL or non-finite"),
    (dict(naive=enumerate([1, 2]), c=enumerate([2, 1])), 3, "no more than 3 dates"),
    (dict(a=enumerate([1, 2]), c=enumerate([2, 1])), 0, "no benchmark"),
    (dict(naive=[(0, 1), (0, 2)], c=[(0, 1), (0, 3)]), 0, "two losses on one date"),
])
def test_incomparable_series_raise(spark, models, lag, what):
    with pytest.raises(Exception, match=what):
        compare.diebold_mariano(table(spark, **models), "naive", max_lag=lag).collect()


def test_nested_sets_and_the_set_of_one_model(spark):
    series = compare.loss_series(table(spark, a=enumerate([1, 2, 1]), b=enumerate([9, 8, 9]),
                                       c=enumerate([4, 4, 5]), d=enumerate([1, 1, 2])))
    got = {r.step: (list(r.models), r.next_to_go) for r in compare.nested_sets(series).collect()}
    assert got == {0: (list("abcd"), "b"), 1: (list("acd"), "c"), 2: (list("ad"), "a")}
    alone = compare.model_confidence_set(compare.loss_series(table(spark, a=enumerate([1, 2])))).first()
    assert list(alone.superior_models) == ["a"] and list(alone.iterations) == []
