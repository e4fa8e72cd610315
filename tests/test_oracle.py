"""A cross-section of the registered queries against DuckDB on the smallest tables.

Hedging is left to the larger tables: here the sparse underlying skips so many days that
carried maturities leave the grid, which is an error by contract (tested below).
"""

import pytest

from checks.compare import connect, differences
from checks.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
NAMES = ("ingest_quotes", "flag_quality", "assign_grid_cell", "tau_years", "spot_daily",
         "observed_surface", "complete_surface", "completion_sensitivity", "liquidity_daily",
         "build_features", "walkforward_splits", "clean_boundary", "write_forecasts_long",
         "daily_loss", "slice_metrics", "shape_diagnostics", "diebold_mariano", "spa_test",
         "model_confidence_set", "standard_book", "tail_risk", "slice_leaders", "mcs_table",
         "refresh_affected")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_engines_agree(spark, duck, name):
    assert differences(spark, duck, SF, name) is None


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_sparse_history_leaves_the_hedging_domain(spark):
    assert queries()["check_hedge_domain"](spark, SF).count() > 0
    with pytest.raises(Exception, match="outside the surface domain"):
        queries()["evaluate_hedging"](spark, SF).collect()
