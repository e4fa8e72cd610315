"""Known input/output vectors of the operators on small hand-built tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions import sqlmath
from optionlake.functions.grid import SurfaceGrid, SurfaceSettings
from optionlake.operators import calendar as cal
from optionlake.operators import contracts, panel, surface

D = dt.date
START, END = D(2003, 12, 1), D(2022, 1, 31)


@pytest.fixture(scope="module")
def lookup(spark):
    sessions = cal.exchange_sessions(spark, START, END)
    return cal.session_lookup(cal.session_table(sessions), START, END).cache()


def day(lookup, date):
    return lookup.filter(F.col("calendar_date") == F.lit(date)).collect()[0]


def test_sessions(lookup):
    assert day(lookup, D(2019, 11, 29)).decision_iso == "2019-11-29T12:45:00-05:00"
    assert day(lookup, D(2019, 7, 1)).decision_iso == "2019-07-01T15:45:00-04:00"
    assert day(lookup, D(2021, 4, 1)).next_session == D(2021, 4, 5)
    assert day(lookup, D(2019, 11, 27)).next_session == D(2019, 11, 29)
    first = day(lookup, D(2004, 1, 2))
    assert first.is_session and first.has_decision_time and first.next_session == D(2004, 1, 5)
    assert not day(lookup, D(2021, 4, 2)).is_session
    assert day(lookup, D(2021, 4, 4)).previous_session == D(2021, 4, 1)
    assert not day(lookup, D(2012, 10, 30)).is_session
    assert not day(lookup, D(2021, 12, 24)).is_session and day(lookup, D(2021, 12, 31)).is_session


def test_session_counts_per_year(lookup):
    counts = {r.y: r.n for r in lookup.filter("is_session").groupBy(
        F.year("calendar_date").alias("y")).agg(F.count("*").alias("n")).collect()}
    assert [counts[y] for y in (2004, 2007, 2012, 2018, 2019, 2020, 2021)] == [
        252, 251, 250, 251, 252, 253, 252]


def test_am_settled_tau(spark, lookup):
    rows = spark.createDataFrame(
        [(D(2021, 4, 15), "SPX", D(2021, 4, 16)), (D(2021, 4, 15), "SPXW", D(2021, 4, 16)),
         (D(2021, 4, 15), "SPXW", D(2021, 4, 14)), (D(2021, 4, 1), "SPXW", D(2021, 4, 2))],
        "quote_date date, root string, expiration date")
    tau = [r.tau_years for r in cal.add_tau_years(rows, lookup).orderBy(
        "quote_date", "root", "expiration").collect()]
    year = 365.0 * 86400
    assert tau[0] == pytest.approx(15 * 60 / year)  # Good Friday expiry rolls back one session
    assert 0.0 < tau[1] < 1.0 / 365.0
    assert tau[2] == 0.0
    assert tau[3] == pytest.approx((86400 + 900) / year)
    holiday = spark.createDataFrame([(D(2021, 4, 2), "SPXW", D(2021, 4, 16))], rows.schema)
    with pytest.raises(Exception, match="no usable decision snapshot"):
        cal.add_tau_years(holiday, lookup).collect()


def test_gap_sessions(spark, lookup):
    rows = spark.createDataFrame(
        [(D(2021, 1, 4), D(2021, 1, 6)), (D(2021, 1, 6), D(2021, 1, 7)),
         (D(2021, 1, 5), D(2021, 1, 8))], "quote_date date, target_date date")
    gaps = [r.target_gap_sessions for r in cal.add_gap_sessions(rows, lookup).orderBy(
        "quote_date").collect()]
    assert gaps == [1, 2, 0]
    bad = spark.createDataFrame([(D(2021, 1, 4), D(2021, 1, 9))], rows.schema)
    with pytest.raises(Exception, match="not a session"):
        cal.add_gap_sessions(bad, lookup).collect()


QUOTE = {"option_type": "C", "bid_1545": 1.0, "ask_1545": 1.2, "implied_volatility_1545": 0.2,
         "vega_1545": 1.0, "active_underlying_price_1545": 100.0, "strike": 100.0,
         "mid_1545": 1.1, "tau_years": 0.1, "total_variance": 0.004, "log_moneyness": 0.0}
SCHEMA = "option_type string, " + ", ".join(f"{c} double" for c in QUOTE if c != "option_type")
INF = float("inf")
SPOILED = [
    ("option_type", None, "MISSING_OPTION_TYPE"), ("bid_1545", None, "MISSING_BID_1545"),
    ("ask_1545", None, "MISSING_ASK_1545"),
    ("implied_volatility_1545", None, "MISSING_IMPLIED_VOLATILITY_1545"),
    ("vega_1545", None, "MISSING_VEGA_1545"),
    ("active_underlying_price_1545", None, "MISSING_ACTIVE_UNDERLYING_PRICE_1545"),
    ("strike", None, "MISSING_STRIKE"), ("mid_1545", None, "MISSING_MID_1545"),
    ("tau_years", None, "MISSING_TAU_YEARS"), ("total_variance", None, "MISSING_TOTAL_VARIANCE"),
    ("log_moneyness", None, "MISSING_LOG_MONEYNESS"),
    ("bid_1545", math.nan, "NONFINITE_BID_1545"), ("ask_1545", INF, "NONFINITE_ASK_1545"),
    ("implied_volatility_1545", math.nan, "NONFINITE_IV_1545"),
    ("vega_1545", -INF, "NONFINITE_VEGA_1545"),
    ("active_underlying_price_1545", INF, "NONFINITE_UNDERLYING_1545"),
    ("strike", math.nan, "NONFINITE_STRIKE"), ("strike", 0.0, "NON_POSITIVE_STRIKE"),
    ("strike", -1.0, "NON_POSITIVE_STRIKE"), ("mid_1545", math.nan, "NONFINITE_MID_1545"),
    ("tau_years", INF, "NONFINITE_TAU_YEARS"),
    ("total_variance", math.nan, "NONFINITE_TOTAL_VARIANCE"),
    ("log_moneyness", math.nan, "NONFINITE_LOG_MONEYNESS"),
    ("option_type", "X", "INVALID_OPTION_TYPE"), ("bid_1545", 0.0, "NON_POSITIVE_BID"),
    ("ask_1545", 0.0, "NON_POSITIVE_ASK"), ("ask_1545", 0.9, "ASK_LT_BID"),
    ("implied_volatility_1545", 0.0, "NON_POSITIVE_IV"), ("vega_1545", 0.0, "NON_POSITIVE_VEGA"),
    ("active_underlying_price_1545", 0.0, "NON_POSITIVE_UNDERLYING_PRICE"),
    ("mid_1545", 0.0, "NON_POSITIVE_MID"), ("tau_years", 5e-5, "TAU_TOO_SHORT"),
    ("tau_years", 2.6, "TAU_TOO_LONG"), ("total_variance", 0.0, "NON_POSITIVE_TOTAL_VARIANCE"),
    ("log_moneyness", 0.51, "OUTSIDE_MONEYNESS_RANGE"), ("log_moneyness", -0.5, None),
]


def test_every_reason_code(spark):
    rows = [tuple((QUOTE | {field: value})[c] for c in QUOTE) + (i,)
            for i, (field, value, _) in enumerate(SPOILED)]
    flagged = panel.flag_quality(spark.createDataFrame(rows, SCHEMA + ", i int"))
    found = [r.invalid_reason for r in flagged.orderBy("i").collect()]
    assert found == [code for _, _, code in SPOILED]


def test_switches_disable_reasons(spark):
    rules = panel.CleaningRules(require_ask_ge_bid=False, require_positive_iv=False,
                                require_positive_vega=False, require_positive_underlying=False)
    rows = [tuple((QUOTE | {f: v})[c] for c in QUOTE) for f, v in (
        ("ask_1545", 0.9), ("implied_volatility_1545", 0.0), ("vega_1545", 0.0),
        ("active_underlying_price_1545", 0.0))]
    assert panel.valid_rows(panel.flag_quality(spark.createDataFrame(rows, SCHEMA), rules)).count() == 4


def test_guard_and_safe_ln(spark):
    assert panel.surface_inputs_guard(spark.createDataFrame(
        [(0.1, 0.0, 0.004, 0.2, 1.0, math.nan), (0.1, 0.0, 0.004, 0.2, 1.0, 0.1),
         (0.1, 0.0, 0.004, 0.2, 0.0, 0.1)],
        ", ".join(f"{c} double" for c in panel.SURFACE_INPUT_COLUMNS))).count() == 2
    row = spark.createDataFrame([(0.0, -1.0, None, math.e)], "a double, b double, c double, d double") \
        .select(*[sqlmath.safe_ln(c).alias(c) for c in "abcd"]).collect()[0]
    assert row.a == -INF and math.isnan(row.b) and row.c is None and row.d == pytest.approx(1.0)


def test_grid_cells(spark):
    grid = SurfaceGrid((30, 60), (-0.1, 0.0, 0.1))
    rows = spark.createDataFrame(
        [(30 / 365, 0.0), (90 / 365, 0.0), (30 / 365, 0.2), (90 / 365, 0.2), (math.nan, 0.0),
         (30 / 365, INF), (None, math.nan), (grid.maturity_edges[0], 0.05)],
        "tau_years double, log_moneyness double")
    found = [(r.maturity_index, r.moneyness_index, r.grid_domain_reason)
             for r in panel.assign_grid_cell(rows, grid).collect()]
    assert found == [
        (0, 1, "VALID_GRID_DOMAIN"), (None, None, "OUTSIDE_MATURITY_GRID_DOMAIN"),
        (None, None, "OUTSIDE_MONEYNESS_GRID_DOMAIN"),
        (None, None, "OUTSIDE_MATURITY_AND_MONEYNESS_GRID_DOMAIN"),
        (None, None, "NONFINITE_MATURITY_GRID_COORDINATE"),
        (None, None, "NONFINITE_MONEYNESS_GRID_COORDINATE"),
        (None, None, "NONFINITE_MATURITY_AND_MONEYNESS_GRID_COORDINATE"),
        (1, 2, "VALID_GRID_DOMAIN")]


@pytest.mark.parametrize("bad", [((), (0.0,)), ((30, 30), (0.0,)), ((30,), (0.1, 0.0)),
                                 ((0,), (0.0,)), ((30,), (math.nan,))])
def test_grid_arguments(bad):
    with pytest.raises(ValueError):
        SurfaceGrid(*bad)


ASSIGNED = ("underlying_symbol string, quote_date date, effective_decision_timestamp string, "
            "maturity_index long, moneyness_index long, total_variance double, "
            "implied_volatility_1545 double, spread_1545 double, vega_1545 double, "
            "inside_grid_domain boolean")


def assigned_row(mi, ki, w, vega):
    return ("A", D(2021, 1, 4), "t", mi, ki, w, math.sqrt(w), 0.1, vega, True)


def test_vega_weighted_mean(spark):
    settings = SurfaceSettings(SurfaceGrid((30,), (0.0,)))
    rows = spark.createDataFrame([assigned_row(0, 0, 0.04, 1.0), assigned_row(0, 0, 0.09, 3.0)],
                                 ASSIGNED)
    cell = surface.observed_surface(rows, settings).collect()[0]
    assert cell.observed_total_variance == pytest.approx(0.0775)
    assert (cell.observation_count, cell.vega_sum, cell.observed_mask) == (2, 4.0, True)


def test_min_count_masks_a_cell_but_completes_it(spark):
    settings = SurfaceSettings(SurfaceGrid((30, 60), (-0.1, 0.0)), observed_cell_min_count=2)
    rows = spark.createDataFrame(
        [assigned_row(0, 0, 0.01, 1.0), assigned_row(0, 0, 0.01, 1.0),
         assigned_row(1, 0, 0.03, 1.0), assigned_row(1, 0, 0.03, 1.0),
         assigned_row(0, 1, 9.99, 1.0)], ASSIGNED)
    gold = surface.gold_rows(surface.gold_days(rows, settings), settings.grid)
    by_cell = {r.cell_index: r for r in gold.collect()}
    assert not by_cell[1].observed_mask and by_cell[1].observation_count == 1
    assert by_cell[1].completed_total_variance == pytest.approx(0.01)
    assert by_cell[1].completion_status == N.EXTRAPOLATED
    assert contracts.check_grid_complete(gold, settings.grid).count() == 0
    missing = gold.filter("cell_index <> 3")
    assert contracts.check_grid_complete(missing, settings.grid).collect()[0].n_distinct_cells == 3
    with pytest.raises(contracts.ContractError):
        contracts.require_empty(contracts.check_grid_complete(missing, settings.grid), "gold")


def test_dense_round_trip(spark):
    settings = SurfaceSettings(SurfaceGrid((30, 60), (-0.1, 0.0)))
    rows = spark.createDataFrame([assigned_row(0, 0, 0.01, 1.0), assigned_row(1, 1, 0.03, 2.0)],
                                 ASSIGNED)
    days = surface.gold_days(rows, settings)
    again = surface.dense_arrays(surface.gold_rows(days, settings.grid),
                                 ("completed_total_variance", "vega_sum"), N.DAY)
    one, two = days.collect()[0], again.collect()[0]
    assert one.completed_total_variance == two.completed_total_variance
    assert two.vega_sum == [1.0, 0.0, 0.0, 2.0]
    liquid = surface.liquidity_daily(days).collect()[0]
    assert (liquid.coverage_ratio, liquid.daily_option_count) == (0.5, 2)
    assert liquid.daily_weighted_spread_1545 == pytest.approx(0.1)


def test_spot_is_the_median_of_valid_rows(spark):
    rows = spark.createDataFrame(
        [("A", D(2021, 1, 4), p, ok) for p, ok in
         ((97.0, True), (97.1, True), (97.2, True), (140.0, False))],
        "underlying_symbol string, quote_date date, active_underlying_price_1545 double, "
        "is_valid_observation boolean")
    row = panel.spot_daily(rows).collect()[0]
    assert row.spot == pytest.approx(97.1) and row.spot_row_count == 3
    with pytest.raises(Exception, match="finite and positive"):
        panel.spot_daily(rows.withColumn("active_underlying_price_1545", F.lit(0.0))).collect()


def test_normal_distribution(spark):
    xs = [-40.0, -8.0, -7.1, -3.0, -0.5, 0.0, 0.5, 3.0, 7.1, 8.0, 40.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", sqlmath.norm_cdf("x").alias("p"), sqlmath.norm_pdf("x").alias("d")).collect()
    for r in rows:
        assert r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=5e-16)
        assert r.d == pytest.approx(math.exp(-r.x * r.x / 2) / math.sqrt(2 * math.pi))


def test_contract_counters(spark):
    df = spark.createDataFrame([("A", 1.0, math.nan), ("A", -1.0, None)],
                               "k string, a double, b double")
    counts = lambda d: {r[0]: r.n_rows for r in d.collect()}
    assert counts(contracts.check_non_null(df, ("a", "b"))) == {"a": 0, "b": 1}
    assert counts(contracts.check_finite(df, ("a", "b"))) == {"a": 0, "b": 2}
    assert counts(contracts.check_nonnegative(df, ("a",))) == {"a": 1}
    assert contracts.check_unique_keys(df, ("k",)).collect()[0].n_rows == 2
