"""Surfaces and spots come from one pass over the source, without copies of the quotes."""

import pytest
from pyspark.sql import functions as F

from checks import queries, view
from checks.queries import SETTINGS
from optionlake.operators import panel, surface
from optionlake.operators.contracts import ContractError
from optionlake.plans.pipeline import Run
from optionlake.sources.stages import StageTables

SMALL = "/root/testdata/sf0.001"


def new_run(spark):
    return Run(lambda: view.raw_quotes(spark, SMALL), SETTINGS, StageTables(spark))


def days(df):
    return {(r.underlying_symbol, str(r.quote_date)): r for r in df.collect()}


def test_surfaces_and_spots_store_no_quotes(spark):
    run = new_run(spark)
    gold, spots = days(run.gold()), days(run.spots())
    assert not {"bronze", "silver"} & run.tables._written
    want = days(surface.gold_days(run.assigned(), SETTINGS.surface))
    assert gold.keys() == want.keys()
    for day, row in gold.items():
        assert row.observation_count == want[day].observation_count
        assert row.completed_total_variance == pytest.approx(want[day].completed_total_variance)
        assert row.weighted_spread_1545 == pytest.approx(want[day].weighted_spread_1545)
    assert spots == days(panel.spot_daily(run.silver()))


def test_unusable_inputs_stop_the_sums(spark, monkeypatch):
    run, flag = new_run(spark), panel.flag_quality
    monkeypatch.setattr(panel, "flag_quality", lambda *a: flag(*a).withColumn(
        "is_valid_observation", F.lit(True)))
    with pytest.raises(ContractError, match="unusable input"):
        run.gold()


def test_panel_is_read_after_its_quotes_are_stored(spark):
    run = queries.run_for(spark, SMALL)
    quotes = run.silver().count()
    read = queries.queries()["read_panel"](spark, SMALL)
    assert read.agg(F.sum("n_rows")).first()[0] == quotes
