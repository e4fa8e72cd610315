"""The registered queries: each Spark operator over the driver's tables, with its SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sql as q
from checks import view as v
from optionlake import deploy
from optionlake import names as N
from optionlake.operators import calendar as cal
from optionlake.operators import (compare, contracts, evaluate, features, forecast, forest, hedge,
                                  panel, pooled, ranks, report, shape, splits,
                                  surface)
from optionlake.plans.pipeline import GATES, Run, RunSettings
from optionlake.sources import quotes as qs
from optionlake.sources import tables
from optionlake.sources.stages import StageTables
from optionlake.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

WALKFORWARD = splits.WalkforwardSettings(126, 21, 21, 21)
#: The quotes of the view hold null keys on purpose, so ``ingest`` only reports here.
SETTINGS = RunSettings(
    v.SETTINGS, v.RULES, walkforward=WALKFORWARD, sessions=cal.weekday_sessions,
    calendar_start=v.CALENDAR_START, calendar_end=v.CALENDAR_END,
    gates=tuple(g for g in GATES if g != "ingest"), source_is_table=True)
BENCHMARK = "naive"
MSE, QLIKE = SETTINGS.loss_metrics
STRESS = [(label, dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for label, a, b in q.STRESS]
WINDOW = (dt.date(1996, 1, 1), dt.date(2000, 12, 31))
SYMBOLS = ("AAA",)
PLANS = (forecast.FitPlan("ridge", {"alpha": 1.0}),
         forecast.FitPlan("har_factor", {"n_factors": 5, "alpha": 1.0}))

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


_runs: dict[tuple[str, str], Run] = {}


def run_for(spark: SparkSession, sf_dir: str) -> Run:
    """The run of an application over one data folder; its stage tables are shared."""
    deploy.prepare(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _runs:
        _runs[key] = Run(lambda: v.raw_quotes(spark, sf_dir), SETTINGS, StageTables(spark))
    return _runs[key]


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def fix(df: DataFrame, spec: str) -> DataFrame:
    """Project to the compared columns: d<digits> doubles, i integers, others as they are."""
    def shown(name: str, kind: str):
        c = F.col(name)
        if kind[0] == "d":
            c = F.round(c.cast("double"), int(kind[1:]))
            c = F.when(c == 0.0, F.lit(0.0)).otherwise(c)
        return c.cast({"i": "bigint", "t": "date", "s": "string", "b": "boolean",
                       "d": "double"}[kind[0]]).alias(name)

    return df.select(*[shown(name, kind) for name, kind in _columns(spec)])


def fixed_sql(spec: str, source: str) -> str:
    def shown(name: str, kind: str) -> str:
        if kind[0] == "d":
            r = f"round(CAST({name} AS DOUBLE), {kind[1:]})"
            return f"CASE WHEN {r} = 0 THEN 0E0 ELSE {r} END AS {name}"
        sql_type = {"i": "BIGINT", "t": "DATE", "s": "VARCHAR", "b": "BOOLEAN"}[kind[0]]
        return f"CAST({name} AS {sql_type}) AS {name}"

    columns = ", ".join(shown(name, kind) for name, kind in _columns(spec))
    text = source.strip()
    return q.assemble(f"SELECT {columns} FROM ({text})" if " " in text
                      else f"SELECT {columns} FROM {text}")


def register(name: str, spec: str, source: str | None = None):
    """Register a function of a Run; `source` is the SQL (or part name) to compare with."""
    def add(build: Callable[[Run], DataFrame]):
        _queries[name] = lambda spark, sf_dir: fix(build(run_for(spark, sf_dir)), spec)
        if source is not None:
            _sql[name] = fixed_sql(spec, source)
        return build

    return add


DAY = "underlying_symbol:s quote_date:t"
FLAGGED = DAY + (" root:s expiration:t strike:d6 option_type:s mid_1545:d6 spread_1545:d6 "
                 "log_moneyness:d8 tau_years:d8 total_variance:d8")

# ---- sources and sinks ----------------------------------------------------------------


@register("ingest_quotes",
          "source_zip:s quote_date:t raw_row_count:i target_symbol_row_count:i "
          "non_target_symbol_row_count:i null_key_count:i status:s", """
SELECT source_zip, min(quote_date) FILTER (underlying_symbol = 'AAA') AS quote_date,
       count(*) AS raw_row_count,
       count(*) FILTER (underlying_symbol = 'AAA') AS target_symbol_row_count,
       count(*) FILTER (underlying_symbol <> 'AAA') AS non_target_symbol_row_count,
       count(*) FILTER (underlying_symbol = 'AAA' AND option_type IS NULL) AS null_key_count,
       CASE WHEN count(*) FILTER (underlying_symbol = 'AAA') = 0 THEN 'error_no_target_rows'
            WHEN count(*) FILTER (underlying_symbol = 'AAA' AND option_type IS NULL) > 0
            THEN 'error_null_keys'
            WHEN min(quote_date) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' THEN 'written'
            ELSE 'skipped_out_of_sample_window' END AS status
FROM quotes GROUP BY source_zip""")
def _ingest(run: Run) -> DataFrame:
    return qs.ingest_summary(run.bronze(), SYMBOLS, *WINDOW)


@register("bronze_rows", DAY + " n_rows:i volume:i", """
SELECT underlying_symbol, quote_date, count(*) AS n_rows, sum(trade_volume) AS volume
FROM quotes WHERE underlying_symbol = 'AAA'
  AND quote_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY ALL""")
def _bronze(run: Run) -> DataFrame:
    return qs.bronze_rows(run.bronze(), SYMBOLS, *WINDOW).groupBy(*N.DAY).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("trade_volume").alias("volume"))


def _day_table(run: Run, name: str, df: Callable[[], DataFrame]) -> str:
    """Write a day-partitioned table once per run and return its path."""
    folder = f"days_{name}"
    path = run.tables.path(folder)
    if folder not in run.tables._written:
        tables.write_day_partitions(df(), path)
        run.tables._written.add(folder)
    return path


@register("read_panel", DAY + " n_rows:i vega:d6", """
SELECT underlying_symbol, quote_date, count(*) AS n_rows, sum(vega_1545) AS vega
FROM flagged GROUP BY ALL""")
def _read_panel(run: Run) -> DataFrame:
    """Partitioned write, then a read of all day folders."""
    path = _day_table(run, "silver", run.flagged)
    return tables.read_panel(run.tables.spark, path).groupBy(*N.DAY).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("vega_1545").alias("vega"))


@register("read_gold_surfaces", DAY + " n_cells:i observed_cells:i total:d8", """
SELECT underlying_symbol, quote_date, count(*) AS n_cells,
       count(*) FILTER (observed_mask) AS observed_cells, sum(completed_total_variance) AS total
FROM gold GROUP BY ALL""")
def _read_gold(run: Run) -> DataFrame:
    run.gold()
    rows = tables.read_gold_surfaces(run.tables.spark, run.tables.path("gold"), run.grid)
    return rows.groupBy(*N.DAY).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if("observed_mask").alias("observed_cells"),
        F.sum("completed_total_variance").alias("total"))


FORECAST = ("underlying_symbol:s model_name:s quote_date:t target_date:t split_id:s cell_index:i "
            "maturity_days:i moneyness_point:d4 effective_decision_timestamp:s "
            "target_effective_decision_timestamp:s predicted_total_variance:d9")


@register("write_forecasts_long", FORECAST, "fc")
def _forecasts_long(run: Run) -> DataFrame:
    return forecast.write_forecasts_long(run.forecasts(), run.grid)


@register("read_forecasts", "underlying_symbol:s model_name:s n_rows:i total:d6", """
SELECT underlying_symbol, model_name, count(*) AS n_rows, sum(predicted_total_variance) AS total
FROM fc GROUP BY ALL""")
def _read_forecasts(run: Run) -> DataFrame:
    run.forecasts()
    rows = tables.read_forecasts(run.tables.spark, run.tables.path("forecasts"), run.grid)
    return rows.groupBy(N.SYMBOL, "model_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("predicted_total_variance").alias("total"))


# ---- panel ----------------------------------------------------------------------------

register("add_derived_fields", FLAGGED, "derived")(lambda run: panel.add_derived_fields(run.bronze()))


@register("add_decision_timestamp", DAY + " effective_decision_timestamp:s n_rows:i", """
SELECT q.underlying_symbol, s.session_date AS quote_date, count(*) AS n_rows,
       CAST(s.session_date AS VARCHAR) || CASE WHEN any_value(s.early) THEN 'T12:45:00-0' ELSE 'T15:45:00-0' END
       || CAST(CAST((epoch(any_value(s.decision_ts)) - epoch(s.session_date
            + CASE WHEN any_value(s.early) THEN TIME '12:45:00' ELSE TIME '15:45:00' END)) / 3600
          AS BIGINT) AS VARCHAR) || ':00' AS effective_decision_timestamp
FROM quotes q ASOF JOIN session_days s ON q.quote_date >= s.session_date
GROUP BY q.underlying_symbol, s.session_date""")
def _decision(run: Run) -> DataFrame:
    """Quotes of exchange holidays count for the session before."""
    lookup = v.exchange_lookup(run.tables.spark)
    settled = cal.with_session(run.bronze(), lookup, columns=("settlement_session",))
    traded = settled.withColumn(N.DATE, F.col("settlement_session")).drop("settlement_session")
    return cal.add_decision_timestamp(traded, lookup).groupBy(*N.DAY, N.DECISION_TS).agg(
        F.count(F.lit(1)).alias("n_rows"))


register("flag_quality", FLAGGED + " invalid_reason:s is_valid_observation:b "
         "effective_decision_timestamp:s", "flagged")(lambda run: run.silver())
register("valid_rows", FLAGGED, "SELECT * FROM flagged WHERE is_valid_observation")(
    lambda run: panel.valid_rows(run.silver()))
register("in_sample_window", DAY + " n_rows:i", """
SELECT underlying_symbol, quote_date, count(*) AS n_rows FROM flagged
WHERE quote_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY ALL""")(
    lambda run: panel.in_sample_window(run.silver(), *WINDOW).groupBy(*N.DAY).agg(
        F.count(F.lit(1)).alias("n_rows")))
register("surface_inputs_guard", DAY + " n_rows:i", """
SELECT underlying_symbol, quote_date, count(*) AS n_rows FROM flagged
WHERE NOT (coalesce(isfinite(tau_years), false) AND coalesce(isfinite(log_moneyness), false)
  AND coalesce(isfinite(total_variance), false) AND coalesce(isfinite(implied_volatility_1545), false)
  AND coalesce(isfinite(vega_1545), false) AND coalesce(isfinite(spread_1545), false)
  AND coalesce(tau_years > 0, false) AND coalesce(total_variance > 0, false)
  AND coalesce(implied_volatility_1545 > 0, false) AND coalesce(vega_1545 > 0, false))
GROUP BY ALL""")(
    lambda run: panel.surface_inputs_guard(run.silver()).groupBy(*N.DAY).agg(
        F.count(F.lit(1)).alias("n_rows")))
register("assign_grid_cell", FLAGGED + " maturity_index:i moneyness_index:i grid_domain_reason:s",
         "placed")(lambda run: run.assigned())
register("total_variance_to_iv", FLAGGED + " iv:d10", """
SELECT *, sqrt(greatest(total_variance, 1E-8) / greatest(tau_years, 1E-12)) AS iv
FROM flagged WHERE is_valid_observation""")(
    lambda run: panel.valid_rows(run.silver()).withColumn("iv", evaluate.total_variance_to_iv(
        F.col("total_variance"), F.col("tau_years"), 1.0e-8)))


@register("log_positive", "underlying_symbol:s quote_date:t cell_index:i log_w:d8 back:d8", """
SELECT underlying_symbol, quote_date, cell_index, ln(completed_total_variance) AS log_w,
       completed_total_variance AS back FROM gold""")
def _log_positive(run: Run) -> DataFrame:
    from optionlake.functions.sqlmath import exp_back, log_positive
    logs = run.gold().withColumn("log_w", log_positive(F.col("completed_total_variance")))
    return surface.dense_rows(logs.withColumn("back", exp_back(F.col("log_w"))), run.grid,
                              ("log_w", "back"), N.DAY)


register("reason_counts", DAY + " reason:s n_rows:i", """
SELECT underlying_symbol, quote_date, coalesce(invalid_reason, 'VALID') AS reason, count(*) AS n_rows
FROM flagged GROUP BY ALL""")(lambda run: panel.reason_counts(run.silver()))
register("reason_counts_grid", DAY + " reason:s n_rows:i", """
SELECT underlying_symbol, quote_date, grid_domain_reason AS reason, count(*) AS n_rows
FROM placed GROUP BY ALL""")(
    lambda run: panel.reason_counts(run.assigned(), "grid_domain_reason"))
register("reason_counts_completion", DAY + " reason:s n_rows:i", """
SELECT underlying_symbol, quote_date, completion_status AS reason, count(*) AS n_rows
FROM gold GROUP BY ALL""")(
    lambda run: panel.reason_counts(surface.gold_rows(run.gold(), run.grid), "completion_status"))
register("spot_daily", DAY + " spot:d6 spot_row_count:i spot_distinct_count:i spot_min:d6 spot_max:d6",
         "spot_days")(lambda run: panel.spot_daily(run.silver()))

# ---- calendar -------------------------------------------------------------------------


@register("session_table", "session_date:t session_no:i early:b close_epoch:i decision_epoch:i n_quotes:i", """
SELECT s.session_date, s.session_no, s.early, epoch(s.close_ts) AS close_epoch,
       epoch(s.decision_ts) AS decision_epoch, count(*) AS n_quotes
FROM quotes q JOIN session_days s ON q.quote_date = s.session_date GROUP BY ALL""")
def _sessions(run: Run) -> DataFrame:
    spark = run.tables.spark
    table = cal.session_table(cal.exchange_sessions(spark, v.CALENDAR_START, v.CALENDAR_END))
    counted = run.bronze().groupBy(N.DATE).agg(F.count(F.lit(1)).alias("n_quotes"))
    return counted.join(table, counted.quote_date == table.session_date, "inner").select(
        "session_date", "session_no", F.col("is_early_close").alias("early"),
        F.unix_timestamp("close_ts").alias("close_epoch"),
        F.unix_timestamp("decision_ts").alias("decision_epoch"), "n_quotes")


@register("previous_next_session", "quote_date:t is_session:b previous_session:t next_session:t n_quotes:i", """
SELECT quote_date, settlement_session = quote_date AS is_session, previous_session, next_session,
       count(*) AS n_quotes
FROM quotes JOIN session_map ON quote_date = calendar_date GROUP BY ALL""")
def _neighbour_sessions(run: Run) -> DataFrame:
    counted = run.bronze().groupBy(N.DATE).agg(F.count(F.lit(1)).alias("n_quotes"))
    return cal.with_session(counted, v.exchange_lookup(run.tables.spark))


@register("effective_decision_ts", "quote_date:t decision_epoch:i has_decision_time:b n_quotes:i", """
SELECT quote_date, epoch(decision_ts) AS decision_epoch, coalesce(close_ts >= decision_ts, false)
       AS has_decision_time, count(*) AS n_quotes
FROM quotes LEFT JOIN session_days ON quote_date = session_date GROUP BY ALL""")
def _effective(run: Run) -> DataFrame:
    counted = run.bronze().groupBy(N.DATE).agg(F.count(F.lit(1)).alias("n_quotes"))
    dated = cal.with_session(counted, v.exchange_lookup(run.tables.spark),
                             columns=("decision_ts", "has_decision_time"))
    return dated.select(N.DATE, F.unix_timestamp("decision_ts").alias("decision_epoch"),
                        F.coalesce("has_decision_time", F.lit(False)).alias("has_decision_time"),
                        "n_quotes")


CONTRACT = "quote_date:t root:s expiration:t"


def _contracts(run: Run) -> DataFrame:
    return run.bronze().select(N.DATE, "root", "expiration").distinct()


register("last_tradable_session", CONTRACT + " last_tradable_session:t", "tradable")(
    lambda run: cal.add_last_tradable(_contracts(run), v.exchange_lookup(run.tables.spark)))
register("tau_years", CONTRACT + " tau_years:d9",
         "SELECT quote_date, root, expiration, tau AS tau_years FROM taus")(
    lambda run: cal.add_tau_years(_contracts(run), v.exchange_lookup(run.tables.spark),
                                  strict=False))


@register("join_tau", DAY + " n_rows:i tau_sum:d6", """
SELECT underlying_symbol, q.quote_date, count(*) AS n_rows, sum(t.tau) AS tau_sum
FROM quotes q LEFT JOIN taus t ON q.quote_date = t.quote_date AND q.root = t.root
 AND q.expiration = t.expiration GROUP BY ALL""")
def _join_tau(run: Run) -> DataFrame:
    tau = cal.add_tau_years(_contracts(run), v.exchange_lookup(run.tables.spark), strict=False)
    return panel.join_tau(run.bronze().drop("tau_years"), tau).groupBy(*N.DAY).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("tau_years").alias("tau_sum"))


register("gap_sessions", DAY + " target_date:t target_gap_sessions:i", """
SELECT DISTINCT underlying_symbol, quote_date, target_date,
       (SELECT count(*) FROM range(1, date_diff('day', quote_date, target_date)) r(i)
        WHERE dayofweek(quote_date + CAST(i AS INTEGER)) BETWEEN 1 AND 5) AS target_gap_sessions
FROM feat""")(lambda run: cal.add_gap_sessions(
    run.features().select(*N.DAY, N.TARGET_DATE), v.weekday_lookup(run.tables.spark)))

# ---- surfaces -------------------------------------------------------------------------

CELL = DAY + " cell_index:i maturity_days:i moneyness_point:d4"
register("observed_surface", CELL + " observed_total_variance:d9 observed_iv:d10 vega_sum:d6 "
         "observation_count:i weighted_spread_1545:d8 observed_mask:b", "dense")(
    lambda run: surface.observed_surface(run.assigned(), v.SETTINGS))
register("complete_surface", CELL + " completed_total_variance:d9 completed_iv:d10 completion_status:s "
         "observed_mask:b effective_decision_timestamp:s", "gold")(
    lambda run: surface.gold_rows(surface.gold_days(run.assigned(), v.SETTINGS), run.grid))
register("surface_build_summary", DAY + " valid_rows:i rows_inside_grid_domain:i "
         "rows_outside_grid_domain:i observed_cells:i status:s", """
SELECT underlying_symbol, quote_date, count(*) FILTER (is_valid_observation) AS valid_rows,
       count(*) FILTER (inside) AS rows_inside_grid_domain,
       count(*) FILTER (is_valid_observation AND NOT inside) AS rows_outside_grid_domain,
       count(DISTINCT CASE WHEN inside THEN cell END) AS observed_cells,
       CASE WHEN count(*) FILTER (is_valid_observation) = 0 THEN 'skipped_no_valid_rows'
            WHEN count(*) FILTER (inside) = 0 THEN 'skipped_no_rows_inside_grid_domain'
            ELSE 'built' END AS status
FROM (SELECT f.underlying_symbol, f.quote_date, f.is_valid_observation,
             f.is_valid_observation AND f.tau_years BETWEEN 7E0/365E0 AND 364E0/365E0
               AND f.log_moneyness BETWEEN -0.3E0 AND 0.3E0 AS inside,
             10 * ((f.tau_years >= 18.5E0/365E0)::INT + (f.tau_years >= 60.5E0/365E0)::INT
                   + (f.tau_years >= 227.5E0/365E0)::INT)
             + (f.log_moneyness >= -0.2E0)::INT + (f.log_moneyness >= -0.05E0)::INT
             + (f.log_moneyness >= 0.05E0)::INT + (f.log_moneyness >= 0.2E0)::INT AS cell
      FROM flagged f) GROUP BY ALL""")(
    lambda run: surface.surface_build_summary(panel.assign_grid_cell(run.silver(), run.grid),
                                              v.SETTINGS))
register("liquidity_daily", DAY + " observed_cell_count:i grid_cell_count:i daily_vega_sum:d6 "
         "daily_option_count:i coverage_ratio:d8 daily_weighted_spread_1545:d8", "liquid")(
    lambda run: surface.liquidity_daily(run.gold()))
register("completion_sensitivity", DAY + " observed_cell_count:i total_cell_count:i mean_abs_diff:d9 "
         "rmse_diff:d9 max_abs_diff:d9", "sensitive")(
    lambda run: surface.completion_sensitivity(run.gold(), v.SETTINGS, ("moneyness", "maturity")))
register("sensitivity_summary", "underlying_symbol:s mean_mean_abs_diff:d9 mean_rmse_diff:d9 "
         "max_max_abs_diff:d9 n_quote_dates:i", """
SELECT underlying_symbol, avg(mean_abs_diff) AS mean_mean_abs_diff, avg(rmse_diff) AS mean_rmse_diff,
       max(max_abs_diff) AS max_max_abs_diff, count(*) AS n_quote_dates FROM sensitive GROUP BY ALL""")(
    lambda run: surface.sensitivity_summary(_sensitivity(run)))


def _sensitivity(run: Run) -> DataFrame:
    return surface.completion_sensitivity(run.gold(), v.SETTINGS, ("moneyness", "maturity"))


MODEL_DAY = "underlying_symbol:s model_name:s quote_date:t target_date:t"


def _shapes(run: Run) -> DataFrame:
    return run.tables.get("shapes", lambda: shape.all_shape_diagnostics(
        run.forecasts(), run.gold(), run.grid))


register("shape_diagnostics", MODEL_DAY + " calendar_violation_count:i calendar_violation_magnitude:d9 "
         "convexity_violation_count:i convexity_violation_magnitude:d8", "shape_daily")(
    lambda run: shape.all_shape_diagnostics(run.forecasts(), run.gold(), run.grid))
register("calendar_violations", DAY + " calendar_violation_count:i calendar_violation_magnitude:d9",
         "SELECT * FROM shape_daily WHERE model_name = 'actual_surface'")(
    lambda run: _shapes(run).filter("model_name = 'actual_surface'"))
register("convexity_violations", DAY + " convexity_violation_count:i convexity_violation_magnitude:d8",
         "SELECT * FROM shape_daily WHERE model_name = 'actual_surface'")(
    lambda run: _shapes(run).filter("model_name = 'actual_surface'"))
register("diagnostic_summary", "underlying_symbol:s model_name:s mean_calendar_violation_count:d8 "
         "mean_calendar_violation_magnitude:d9 mean_convexity_violation_count:d8 "
         "mean_convexity_violation_magnitude:d8 n_surfaces:i", """
SELECT underlying_symbol, model_name, avg(calendar_violation_count) AS mean_calendar_violation_count,
       avg(calendar_violation_magnitude) AS mean_calendar_violation_magnitude,
       avg(convexity_violation_count) AS mean_convexity_violation_count,
       avg(convexity_violation_magnitude) AS mean_convexity_violation_magnitude,
       count(*) AS n_surfaces FROM shape_daily GROUP BY ALL""")(
    lambda run: shape.diagnostic_summary(_shapes(run)))
register("shape_penalties", "underlying_symbol:s model_name:s split_id:s calendar_penalty:d9 "
         "convexity_penalty:d8 roughness_penalty:d9", """
SELECT underlying_symbol, model_name, split_id, avg(greatest(-rise, 0)) FILTER (rise IS NOT NULL)
         AS calendar_penalty,
       avg(greatest(-curvature, 0)) FILTER (curvature IS NOT NULL) AS convexity_penalty,
       avg(bend_t * bend_t) + avg(bend_k * bend_k) AS roughness_penalty
FROM shaped WHERE split_id IS NOT NULL GROUP BY ALL""")(
    lambda run: shape.shape_penalties(run.forecasts(), "predictions", run.grid,
                                      (N.SYMBOL, "model_name", "split_id")))
register("dense_arrays", DAY + " values_text:s", """
SELECT underlying_symbol, quote_date,
       string_agg(CAST(CAST(round(completed_total_variance * 1E8) AS BIGINT) AS VARCHAR), ','
                  ORDER BY cell_index) AS values_text FROM gold GROUP BY ALL""")(
    lambda run: surface.dense_arrays(
        surface.gold_rows(run.gold(), run.grid), ("completed_total_variance",), N.DAY).select(
        *N.DAY, F.array_join(F.transform("completed_total_variance", lambda w: F.round(
            w * 1e8).cast("bigint").cast("string")), ",").alias("values_text")))

# ---- features and splits --------------------------------------------------------------

FEATURE_SPEC = DAY + (" target_date:t cell_index:i feature_surface_mean_01:d9 feature_surface_mean_05:d9 "
                      "feature_surface_mean_22:d9 feature_surface_change_01:d9 feature_mask_mean_01:d8 "
                      "feature_mask_mean_05:d8 feature_mask_mean_22:d8 target_total_variance:d9 "
                      "target_observed_mask:d1 target_vega_weight:d6 target_training_weight:d6")
FEATURE_SQL = """
SELECT underlying_symbol, quote_date, target_date, cell_index, mean_01 AS feature_surface_mean_01,
       mean_05 AS feature_surface_mean_05, mean_22 AS feature_surface_mean_22,
       change_01 AS feature_surface_change_01, mask_01 AS feature_mask_mean_01,
       mask_05 AS feature_mask_mean_05, mask_22 AS feature_mask_mean_22,
       target_w AS target_total_variance, target_mask AS target_observed_mask,
       target_vega AS target_vega_weight,
       CASE WHEN target_mask = 1 THEN target_vega ELSE 1 END AS target_training_weight FROM feat"""
register("feature_windows", FEATURE_SPEC, FEATURE_SQL)(
    lambda run: features.feature_cells(run.gold(), run.grid))


@register("build_features", FEATURE_SPEC + " coverage_ratio:d8 daily_option_count:i "
          "daily_vega_sum:d6 daily_weighted_spread_1545:d8 target_effective_decision_timestamp:s",
          FEATURE_SQL.replace("FROM feat", """,
       coverage_ratio, daily_option_count, daily_vega_sum, daily_weighted_spread_1545,
       target_effective_decision_timestamp
FROM feat JOIN liquid USING (underlying_symbol, quote_date)"""))
def _features(run: Run) -> DataFrame:
    settings = features.FeatureSettings()
    scalars = {f"feature_{s}": s for s in features.LIQUIDITY_FEATURES}
    days = run.features().withColumnsRenamed(scalars)
    return surface.dense_rows(days, run.grid, (*settings.feature_arrays, *features.TARGET_ARRAYS),
                              (*N.DAY, N.TARGET_DATE, N.TARGET_TS, *scalars.values()))


@register("widen_features", DAY + " feature_surface_mean_01_0000:d9 feature_surface_mean_22_0019:d9 "
          "feature_surface_change_01_0007:d9 feature_mask_mean_05_0012:d8 target_total_variance_0019:d9", """
SELECT underlying_symbol, quote_date, max(mean_01) FILTER (cell_index = 0) AS feature_surface_mean_01_0000,
       max(mean_22) FILTER (cell_index = 19) AS feature_surface_mean_22_0019,
       max(change_01) FILTER (cell_index = 7) AS feature_surface_change_01_0007,
       max(mask_05) FILTER (cell_index = 12) AS feature_mask_mean_05_0012,
       max(target_w) FILTER (cell_index = 19) AS target_total_variance_0019 FROM feat GROUP BY ALL""")
def _widen(run: Run) -> DataFrame:
    wide = features.widen_features(run.features(), run.grid)
    features.check_feature_layout(wide.columns, run.grid)
    return wide


BLOCKS = ("mean_01", "mean_05", "mean_22", "change_01", "mask_01", "mask_05", "mask_22")
register("feature_matrix", DAY + " position:i value:d8", "\nUNION ALL\n".join(
    [f"SELECT underlying_symbol, quote_date, {20 * k} + cell_index AS position, {name} AS value FROM feat"
     for k, name in enumerate(BLOCKS)] + [f"""
SELECT underlying_symbol, quote_date, {20 * len(BLOCKS) + k} AS position, {name} AS value FROM liquid
SEMI JOIN feat USING (underlying_symbol, quote_date)""" for k, name in enumerate(features.LIQUIDITY_FEATURES)]))(
    lambda run: run.features().select(*N.DAY, F.posexplode(features.feature_vector()).alias(
        "position", "value")))
register("training_weights", DAY + " weight_sum:d6 observed:i", """
SELECT underlying_symbol, quote_date, sum(CASE WHEN target_mask = 1 THEN target_vega ELSE 1 END) AS weight_sum,
       count(*) FILTER (target_mask = 1) AS observed FROM feat GROUP BY ALL""")(
    lambda run: features.feature_cells(run.gold(), run.grid).groupBy(*N.DAY).agg(
        F.sum("target_training_weight").alias("weight_sum"),
        F.count_if(F.col("target_observed_mask") == 1.0).alias("observed")))
register("leakage_check", "column_name:s n_rows:i", """
SELECT unnest(['feature_surface_mean_01', 'feature_surface_mean_05', 'feature_surface_mean_22',
 'feature_surface_change_01', 'feature_mask_mean_01', 'feature_mask_mean_05', 'feature_mask_mean_22',
 'feature_coverage_ratio', 'feature_daily_option_count', 'feature_daily_vega_sum',
 'feature_daily_weighted_spread_1545', 'target_total_variance', 'target_observed_mask',
 'target_vega_weight', 'target_training_weight', 'target_date']) AS column_name,
 (SELECT count(*) FROM feat WHERE target_date <= quote_date) AS n_rows""")(
    lambda run: contracts.leakage_check(run.features()))
LATE = ", ".join(f"count(*) FILTER (newest_{days} > decided) AS n_{days}" for days in (1, 2, 5, 22))


@register("leakage_lineage", "column_name:s n_rows:i", f"""
WITH known AS (
  SELECT underlying_symbol, quote_date, quote_date + TIME '15:45:00' AS decided, quote_date + TIME '15:45:00'
    + CASE WHEN day(quote_date) <= 10 THEN INTERVAL 156 HOUR ELSE INTERVAL 0 HOUR END AS known_at
  FROM (SELECT DISTINCT underlying_symbol, quote_date FROM gold)),
traced AS (SELECT underlying_symbol, quote_date, decided, {", ".join(
    f"max(known_at) OVER (PARTITION BY underlying_symbol ORDER BY quote_date "
    f"ROWS BETWEEN {days - 1} PRECEDING AND CURRENT ROW) AS newest_{days}" for days in (1, 2, 5, 22))}
  FROM known),
counts AS (SELECT {LATE} FROM traced
  SEMI JOIN (SELECT DISTINCT underlying_symbol, quote_date FROM feat) USING (underlying_symbol, quote_date))
SELECT unnest(['feature_surface_mean_01', 'feature_surface_mean_05', 'feature_surface_mean_22',
  'feature_surface_change_01', 'feature_mask_mean_01', 'feature_mask_mean_05', 'feature_mask_mean_22',
  'feature_coverage_ratio', 'feature_daily_option_count', 'feature_daily_vega_sum',
  'feature_daily_weighted_spread_1545']) AS column_name,
  unnest([n_1, n_5, n_22, n_2, n_1, n_5, n_22, n_1, n_1, n_1, n_1]) AS n_rows FROM counts""")
def _lineage(run: Run) -> DataFrame:
    """Surfaces of the first ten days of a month are revised 156 hours later: a leak to be found."""
    revised = F.when(F.dayofmonth(N.DATE) <= 10, F.expr("interval 156 hours")).otherwise(
        F.expr("interval 0 hours"))
    gold = run.gold().withColumn("known_at", F.to_timestamp(N.DECISION_TS) + revised)
    late = contracts.leakage_check(run.features(), features.feature_lineage(gold, "known_at"))
    return late.filter("column_name like 'feature%'")


register("walkforward_splits", "underlying_symbol:s split_id:s role:s quote_date:t", "split_rows")(
    lambda run: splits.walkforward_splits(run.features(), WALKFORWARD))
register("clean_boundary", "underlying_symbol:s max_hpo_validation_date:t first_clean_test_split_id:s "
         "n_splits:i n_clean_splits:i", """
SELECT underlying_symbol, max(max_hpo_validation_date) AS max_hpo_validation_date,
       min(split_id) FILTER (first_test > max_hpo_validation_date) AS first_clean_test_split_id,
       count(*) AS n_splits, count(*) FILTER (first_test > max_hpo_validation_date) AS n_clean_splits
FROM edges GROUP BY ALL""")(lambda run: run.boundary())
register("clean_splits", "underlying_symbol:s split_id:s quote_date:t", "tested")(
    lambda run: run.test_dates())
register("universe_hash", "underlying_symbol:s universe_hash:s n_dates:i", """
SELECT underlying_symbol, sha256(to_json(list(CAST(quote_date AS VARCHAR) ORDER BY quote_date)))
       AS universe_hash, count(*) AS n_dates FROM positions GROUP BY ALL""")(
    lambda run: splits.universe_hash(run.features()))
register("check_splits", "underlying_symbol:s split_id:s role:s quote_date:t violation:s", """
SELECT underlying_symbol, split_id, role, quote_date, 'MISSING' AS violation
FROM split_rows WHERE dayofmonth(quote_date) = 15 AND role = 'test'""")(
    lambda run: splits.check_splits(
        run.splits().filter("not (dayofmonth(quote_date) = 15 and role = 'test')"),
        run.features(), WALKFORWARD))

# ---- forecasts and evaluation ---------------------------------------------------------

register("forecast_persistence", FORECAST, "SELECT * FROM fc WHERE model_name = 'naive'")(
    lambda run: forecast.write_forecasts_long(forecast.project_forecasts(
        run.features(), run.test_dates(), "run", {"naive": "feature_surface_mean_01"}), run.grid))
register("walkforward_run", FORECAST, "fc")(lambda run: forecast.write_forecasts_long(
    forecast.project_forecasts(run.features(), run.test_dates(), "run"), run.grid))
register("forecast_artifact_summary", "underlying_symbol:s model_name:s row_count:i quote_date_count:i "
         "target_date_count:i split_count:i first_quote_date:t last_target_date:t", """
SELECT underlying_symbol, model_name, count(*) AS row_count, count(DISTINCT quote_date) AS quote_date_count,
       count(DISTINCT target_date) AS target_date_count, count(DISTINCT split_id) AS split_count,
       min(quote_date) AS first_quote_date, max(target_date) AS last_target_date FROM fc GROUP BY ALL""")(
    lambda run: forecast.forecast_artifact_summary(run.forecasts(), run.grid))
register("prediction_health", "underlying_symbol:s model_name:s split_id:s prediction_mean:d9 "
         "target_mean:d9 prediction_target_ratio:d8 near_zero_share:d8", """
SELECT underlying_symbol, model_name, split_id, avg(predicted_total_variance) AS prediction_mean,
       avg(target_w) AS target_mean, avg(predicted_total_variance) / avg(target_w) AS prediction_target_ratio,
       avg(CAST(predicted_total_variance < 1E-6 AS INT)) AS near_zero_share FROM fc GROUP BY ALL""")(
    lambda run: forecast.prediction_health(run.forecasts(), run.features()))
register("weighted_surface_mse", "underlying_symbol:s model_name:s split_id:s weighted_surface_mse:d10", """
SELECT underlying_symbol, model_name, split_id,
       sum((predicted_total_variance - target_w) ** 2 * w) / sum(w) AS weighted_surface_mse
FROM (SELECT *, CASE WHEN target_mask = 1 THEN target_vega ELSE 0.25E0 END AS w FROM fc) GROUP BY ALL""")(
    lambda run: features.weighted_surface_mse(
        run.forecasts().join(run.features().select(*N.DAY, *features.TARGET_ARRAYS), list(N.DAY)),
        "predictions", 1.0, 0.25, (N.SYMBOL, "model_name", "split_id")))
register("realization_panel", MODEL_DAY + " split_id:s cell_index:i predicted_total_variance:d9 "
         "actual_completed_total_variance:d9 actual_completed_iv:d10 predicted_iv:d10 actual_iv_change:d10 "
         "predicted_iv_change:d10 observed_weight:d6 actual_observed_mask:b actual_completion_status:s",
         "joined")(lambda run: run.panel())
register("panel_mismatches", "check_name:s n_rows:i", """
SELECT unnest(['actual_effective_decision_timestamp', 'origin_effective_decision_timestamp',
 'actual_surface_grid_schema_version', 'actual_surface_grid_hash', 'actual_maturity_coordinate',
 'actual_moneyness_coordinate', 'actual_target_surface_version', 'actual_surface_config_hash',
 'origin_surface_grid_schema_version', 'origin_surface_grid_hash', 'origin_maturity_coordinate',
 'origin_moneyness_coordinate', 'origin_target_surface_version', 'origin_surface_config_hash',
 'actual_surface', 'origin_surface']) AS check_name,
 (SELECT count(*) FROM fc f LEFT JOIN gold a ON a.underlying_symbol = f.underlying_symbol
   AND a.quote_date = f.target_date AND a.cell_index = f.cell_index
  WHERE a.cell_index IS NULL) AS n_rows""")(
    lambda run: evaluate.panel_mismatches(evaluate.matched_days(run.forecasts(), run.gold())))
_LOSS_COLUMNS = " ".join(f"{scope}_{m}:d9" for scope in ("observed", "full") for m in evaluate.METRICS)
register("daily_loss", MODEL_DAY + f" {_LOSS_COLUMNS} interpolated_cell_count:i extrapolated_cell_count:i "
         "observed_cell_count:i full_grid_cell_count:i", "daily")(
    lambda run: evaluate.daily_loss(run.panel()))
SUMMARY = ("underlying_symbol:s model_name:s mean_observed_mse_total_variance:d10 "
           "mean_observed_qlike_total_variance:d8 std_observed_mse_total_variance:d10 "
           "std_observed_qlike_total_variance:d8 n_target_dates:i")


def _summary(run: Run) -> DataFrame:
    return evaluate.loss_summary(run.daily_loss(), SETTINGS.loss_metrics)


register("loss_summary", SUMMARY, "summary")(_summary)
register("mean_daily_loss", "underlying_symbol:s model_name:s mean_daily_loss:d8 n_target_dates:i", """
SELECT underlying_symbol, model_name, avg(full_wrmse_iv) AS mean_daily_loss, count(*) AS n_target_dates
FROM daily GROUP BY ALL""")(
    lambda run: evaluate.mean_daily_loss(run.daily_loss(), "full_wrmse_iv"))
register("day_win_counts", "underlying_symbol:s model_name:s days_better:i days_worse:i "
         "mean_difference:d10 median_difference:d10 n_days:i", """
SELECT c.underlying_symbol, c.model_name,
       count(*) FILTER (c.observed_mse_total_variance < b.observed_mse_total_variance) AS days_better,
       count(*) FILTER (c.observed_mse_total_variance > b.observed_mse_total_variance) AS days_worse,
       avg(c.observed_mse_total_variance - b.observed_mse_total_variance) AS mean_difference,
       median(c.observed_mse_total_variance - b.observed_mse_total_variance) AS median_difference,
       count(*) AS n_days
FROM daily c JOIN daily b USING (underlying_symbol, quote_date, target_date)
WHERE b.model_name = 'naive' AND c.model_name <> 'naive' GROUP BY ALL""")(
    lambda run: evaluate.day_win_counts(run.daily_loss(), MSE, BENCHMARK))
SLICES = ("underlying_symbol:s model_name:s slice_family:s slice_label:s slice_value_float:d4 "
          "evaluation_scope:s " + " ".join(f"{m}:d9" for m in evaluate.METRICS)
          + " cell_count:i target_day_count:i")


def _slices(run: Run) -> DataFrame:
    return run.tables.get("slices", lambda: evaluate.slice_metrics(run.panel(), STRESS))


register("slice_metrics", SLICES, "sliced")(
    lambda run: evaluate.slice_metrics(run.panel(), STRESS))
register("stress_window_membership", "target_date:t label:s n_days:i", """
SELECT target_date, label, count(*) AS n_days FROM (SELECT DISTINCT target_date FROM daily) JOIN (VALUES """
         + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in q.STRESS)
         + ") w(label, a, b) ON target_date BETWEEN a AND b GROUP BY ALL")(
    lambda run: run.daily_loss().select(N.TARGET_DATE).distinct().select(
        N.TARGET_DATE, F.explode(evaluate.in_stress_windows(F.col(N.TARGET_DATE), STRESS))
        .alias("label")).groupBy(N.TARGET_DATE, "label").agg(F.count(F.lit(1)).alias("n_days")))
register("assert_equal_coverage", "underlying_symbol:s quote_date:t maturity_index:i moneyness_index:i "
         "n_models:i n_models_expected:i", """
SELECT underlying_symbol, quote_date, cell_index // 5 AS maturity_index, cell_index % 5 AS moneyness_index,
       2 AS n_models, 3 AS n_models_expected
FROM fc WHERE model_name = 'mean5' AND dayofmonth(quote_date) = 15""")(
    lambda run: evaluate.assert_equal_coverage(
        forecast.write_forecasts_long(run.forecasts(), run.grid).filter(
            "not (model_name = 'mean5' and dayofmonth(quote_date) = 15)")))
register("assert_after_boundary", "underlying_symbol:s model_name:s quote_date:t", """
SELECT DISTINCT m.model_name, r.underlying_symbol, r.quote_date
FROM split_rows r JOIN (SELECT DISTINCT underlying_symbol, max_hpo_validation_date FROM edges) e
USING (underlying_symbol) CROSS JOIN (SELECT unnest(['naive', 'mean5', 'mean22']) AS model_name) m
WHERE r.role = 'test' AND r.quote_date <= e.max_hpo_validation_date""")(
    lambda run: evaluate.assert_after_boundary(
        forecast.project_forecasts(run.features(), run.splits().filter("role = 'test'"), "all"),
        run.boundary()))


@register("check_boundary_match", "underlying_symbol:s recorded_first_clean_test_split_id:s "
          "first_clean_test_split_id:s", """
SELECT underlying_symbol, min(split_id) FILTER (split_no > 0 AND first_test > two) AS
         recorded_first_clean_test_split_id,
       min(split_id) FILTER (first_test > max_hpo_validation_date) AS first_clean_test_split_id
FROM edges JOIN (SELECT underlying_symbol, max(last_validation) AS two FROM edges WHERE split_no < 2
                 GROUP BY ALL) USING (underlying_symbol) GROUP BY underlying_symbol""")
def _boundary_match(run: Run) -> DataFrame:
    """A boundary recorded with two tuning splits against one recomputed with three."""
    return evaluate.check_boundary_match(splits.clean_boundary(run.splits(), 2), run.boundary())


# ---- comparison tests -----------------------------------------------------------------

SERIES = "underlying_symbol:s loss_metric:s"
register("loss_matrix", "underlying_symbol:s target_date:t naive:d10 mean5:d10 mean22:d10", """
SELECT underlying_symbol, target_date, max(observed_mse_total_variance) FILTER (model_name = 'naive') AS naive,
       max(observed_mse_total_variance) FILTER (model_name = 'mean5') AS mean5,
       max(observed_mse_total_variance) FILTER (model_name = 'mean22') AS mean22 FROM daily GROUP BY ALL""")(
    lambda run: compare.loss_matrix(run.daily_loss(), MSE, ("naive", "mean5", "mean22")))
register("loss_matrix_violations", "underlying_symbol:s target_date:t n_models:i", """
SELECT underlying_symbol, target_date, 2 AS n_models FROM daily
WHERE model_name = 'mean22' AND dayofmonth(target_date) = 15""")(
    lambda run: compare.loss_matrix_violations(
        run.daily_loss().filter("not (model_name = 'mean22' and dayofmonth(target_date) = 15)"), MSE))
register("diebold_mariano", SERIES + " model_b:s n_obs:i mean_loss_a:d9 mean_loss_b:d9 "
         "mean_differential:d10 long_run_variance:d9 statistic:d6 p_value:d9", "dm")(
    lambda run: compare.diebold_mariano(run.losses(), BENCHMARK, "greater", 2))
@register("load_test_records", SERIES + " model_b:s n_obs:i statistic:d6 p_value:d9",
          f"SELECT * FROM dm WHERE loss_metric = '{MSE}'")
def _stored_tests(run: Run) -> DataFrame:
    run.tables.get("dm_records", lambda: compare.diebold_mariano(run.losses(), BENCHMARK, "greater", 2))
    return tables.load_test_records(run.tables.spark, run.tables.path("dm_records"), MSE)


@register("write_report_table", MODEL_DAY + f" {MSE}:d9", "SELECT * FROM daily")
def _report_table(run: Run) -> DataFrame:
    """Every daily loss as a report, read back from its exact copy."""
    path = run.tables.path("daily_report")
    tables.write_report_table(run.daily_loss(), path, (*N.DAY, "model_name", N.TARGET_DATE))
    return run.tables.spark.read.parquet(f"{path}/parquet")


register("block_bootstrap", SERIES + " model_name:s rep:i rep_mean:d9", "rep_means_7")(
    lambda run: compare.bootstrap_means(run.loss_series(), 5, 500, 7).select(
        *compare.SERIES, F.explode(F.arrays_zip("models", "rep_means")).alias("m")).select(
        *compare.SERIES, F.col("m.models").alias("model_name"),
        F.posexplode("m.rep_means").alias("rep", "rep_mean")))


def _spa(run: Run) -> DataFrame:
    return compare.spa_test(run.loss_series(), BENCHMARK)


def _mcs(run: Run) -> DataFrame:
    return compare.model_confidence_set(run.loss_series())


register("spa_test", SERIES + " observed_statistic:d6 p_value:d6", "spa")(_spa)
register("model_confidence_set_step", SERIES + " test_statistic:d4 p_value:d6", "tmax_7")(
    lambda run: compare.tmax_step(run.loss_series(), 5, 500, 7))
register("model_confidence_set", SERIES + " model_name:s", "kept")(
    lambda run: _mcs(run).select(*compare.SERIES, F.explode("superior_models").alias("model_name")))

# ---- hedging --------------------------------------------------------------------------

register("standard_book", DAY + " label:s option_type:s quantity:d4 strike:d6 initial_maturity_days:i", """
SELECT underlying_symbol, quote_date, label, option_type, quantity, spot * exp(shift) AS strike,
       days AS initial_maturity_days FROM spot_days CROSS JOIN instruments WHERE NOT is_hedge""")(
    lambda run: hedge.standard_book(run.spots()))
VALUED = MODEL_DAY + " label:s state:s remaining_days:i"


def _valued(run: Run) -> DataFrame:
    return run.tables.get("valued", lambda: hedge.value_instruments(run.trades(), run.grid))


register("surface_sigma", VALUED + " log_moneyness:d8 sigma:d10", "with_sigma")(_valued)
register("black_scholes", VALUED + " price:d6 delta:d8 vega:d6", "priced")(_valued)
register("value_book", MODEL_DAY + " state:s total_value:d6 total_delta:d7 total_vega:d5", """
SELECT underlying_symbol, model_name, quote_date, target_date, state, sum(price) AS total_value,
       sum(delta) AS total_delta, sum(vega) AS total_vega FROM priced WHERE NOT is_hedge GROUP BY ALL""")(
    lambda run: hedge.value_book(_valued(run)))
register("delta_vega_hedge", MODEL_DAY + " straddle_quantity:d6 underlying_quantity:d6 hedge_status:s", """
SELECT *, 'ok' AS hedge_status FROM hedged""")(lambda run: run.hedging())
register("evaluate_hedging", MODEL_DAY + " spot_t:d6 spot_t1:d6 book_value_t0:d6 predicted_book_value_t1:d6 "
         "actual_book_value_t1:d6 revaluation_error:d6 unhedged_pnl:d6 hedged_pnl:d5", "hedged")(
    lambda run: hedge.evaluate_hedging(run.trades(), run.grid))
HEDGE_SUMMARY = ("underlying_symbol:s model_name:s mean_abs_revaluation_error:d6 "
                 "mean_squared_revaluation_error:d4 mean_abs_hedged_pnl:d6 mean_squared_hedged_pnl:d4 "
                 "hedged_pnl_variance:d4 n_trades:i")


def _hedge_summary(run: Run) -> DataFrame:
    return hedge.hedging_summary(run.hedging())


register("hedging_summary", HEDGE_SUMMARY, "hedge_means")(_hedge_summary)
register("check_hedge_domain", "underlying_symbol:s quote_date:t target_date:t field_name:s value:d8", """
SELECT underlying_symbol, quote_date, target_date, field_name, value
FROM (SELECT DISTINCT underlying_symbol, quote_date, target_date, ln(spot_t / spot_t1) AS s,
             date_diff('day', quote_date, target_date) AS gap FROM trade_paths) p,
     LATERAL (SELECT unnest([
       {'field_name': 'atm_target_log_moneyness', 'value': s, 'bad': abs(s) > 0.3E0},
       {'field_name': 'rr_put_target_log_moneyness', 'value': s - 0.28E0, 'bad': abs(s - 0.28E0) > 0.3E0},
       {'field_name': 'rr_call_target_log_moneyness', 'value': s + 0.28E0, 'bad': abs(s + 0.28E0) > 0.3E0},
       {'field_name': 'hedge_straddle_target_log_moneyness', 'value': s, 'bad': abs(s) > 0.3E0},
       {'field_name': 'short_maturity_days_after_gap', 'value': 10E0 - gap, 'bad': 10 - gap < 7},
       {'field_name': 'long_maturity_days_after_gap', 'value': 90E0 - gap, 'bad': 90 - gap < 7},
       {'field_name': 'hedge_maturity_days_after_gap', 'value': 30E0 - gap, 'bad': 30 - gap < 7}],
       recursive := true)) u
WHERE bad""")(
    lambda run: hedge.check_hedge_domain(
        run.forecasts(), run.spots(), run.grid,
        hedge.HedgeSettings(skew_moneyness_abs=0.28, short_maturity_days=10)))
register("check_hedge_coverage", MODEL_DAY + " violation:s", """
SELECT DISTINCT underlying_symbol, model_name, quote_date, target_date, 'MISSING' AS violation
FROM fc WHERE dayofmonth(quote_date) = 15""")(
    lambda run: hedge.check_hedge_coverage(
        run.hedging().filter("dayofmonth(quote_date) <> 15"), run.forecasts()))
register("check_hedge_summary", "underlying_symbol:s model_name:s n_trades:i", """
SELECT underlying_symbol, model_name, n_trades + 1 AS n_trades FROM hedge_means
WHERE model_name = 'naive'""")(
    lambda run: hedge.check_hedge_summary(
        _hedge_summary(run).withColumn("n_trades", F.col("n_trades") + F.when(
            F.col("model_name") == "naive", 1).otherwise(0)), run.hedging()))

# ---- contracts ------------------------------------------------------------------------

register("check_non_null", "column_name:s n_rows:i", """
SELECT unnest(['option_type', 'bid_1545', 'ask_1545', 'strike', 'root']) AS column_name,
       unnest([count(*) FILTER (option_type IS NULL), count(*) FILTER (bid_1545 IS NULL),
               count(*) FILTER (ask_1545 IS NULL), count(*) FILTER (strike IS NULL),
               count(*) FILTER (root IS NULL)]) AS n_rows FROM quotes""")(
    lambda run: contracts.check_non_null(
        run.bronze(), ("option_type", "bid_1545", "ask_1545", "strike", "root")))
register("check_finite", "column_name:s n_rows:i", """
SELECT unnest(['bid_1545', 'ask_1545', 'strike']) AS column_name,
       unnest([count(*) FILTER (bid_1545 IS NULL OR NOT isfinite(bid_1545)),
               count(*) FILTER (ask_1545 IS NULL OR NOT isfinite(ask_1545)),
               count(*) FILTER (strike IS NULL OR NOT isfinite(strike))]) AS n_rows FROM quotes""")(
    lambda run: contracts.check_finite(run.bronze(), ("bid_1545", "ask_1545", "strike")))
register("check_nonnegative", "column_name:s n_rows:i", """
SELECT unnest(['spread_1545', 'log_moneyness']) AS column_name,
       unnest([count(*) FILTER (spread_1545 < 0), count(*) FILTER (log_moneyness < 0)]) AS n_rows
FROM flagged""")(
    lambda run: contracts.check_nonnegative(run.silver(), ("spread_1545", "log_moneyness")))
register("check_equal_columns", "comparison:s n_rows:i", """
SELECT unnest(['bid_1545=ask_1545', 'quote_date=expiration']) AS comparison,
       unnest([count(*) FILTER (bid_1545 IS DISTINCT FROM ask_1545),
               count(*) FILTER (quote_date IS DISTINCT FROM expiration)]) AS n_rows FROM quotes""")(
    lambda run: contracts.check_equal_columns(
        run.bronze(), (("bid_1545", "ask_1545"), ("quote_date", "expiration"))))


@register("check_single_date", "source_zip:s n_quote_dates:i", """
SELECT strftime(quote_date, '%Y-%m') AS source_zip, count(DISTINCT quote_date) AS n_quote_dates
FROM quotes GROUP BY ALL HAVING count(DISTINCT quote_date) <> 1""")
def _single_date(run: Run) -> DataFrame:
    """Months stand in for files that mix dates; the view's real files never do."""
    return contracts.check_single_date(
        run.bronze().withColumn("source_zip", F.date_format(N.DATE, "yyyy-MM")))


register("check_symbols", "underlying_symbol:s n_rows:i", """
SELECT underlying_symbol, count(*) AS n_rows FROM quotes WHERE underlying_symbol <> 'AAA' GROUP BY ALL""")(
    lambda run: contracts.check_symbols(run.bronze(), SYMBOLS))
register("check_window", "quote_date:t n_rows:i", """
SELECT quote_date, count(*) AS n_rows FROM quotes
WHERE quote_date NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY ALL""")(
    lambda run: contracts.check_window(run.bronze(), *WINDOW))
register("check_unique_keys", DAY + " root:s expiration:t strike:d6 option_type:s n_rows:i", """
SELECT underlying_symbol, quote_date, root, expiration, strike, option_type, count(*) AS n_rows
FROM quotes GROUP BY ALL HAVING count(*) > 1""")(
    lambda run: contracts.check_unique_keys(
        run.bronze(), (*N.DAY, "root", "expiration", "strike", "option_type")))
register("missing_keys", DAY + " violation:s", """
SELECT DISTINCT g.underlying_symbol, g.quote_date, 'MISSING' AS violation FROM gold g
WHERE NOT EXISTS (SELECT 1 FROM fc f WHERE f.underlying_symbol = g.underlying_symbol
                  AND f.quote_date = g.quote_date)""")(
    lambda run: contracts.missing_keys(run.gold(), run.forecasts(), N.DAY))
register("check_grid_complete", DAY + " n_rows:i n_distinct_cells:i n_duplicates:i n_foreign:i", """
SELECT underlying_symbol, quote_date, count(*) AS n_rows, count(*) AS n_distinct_cells, 0 AS n_duplicates,
       0 AS n_foreign
FROM gold WHERE NOT (completion_status = 'interpolated') GROUP BY ALL HAVING count(*) <> 20""")(
    lambda run: contracts.check_grid_complete(
        surface.gold_rows(run.gold(), run.grid).filter("completion_status <> 'interpolated'"),
        run.grid))
register("check_grid_metadata", "column_name:s n_rows:i", """
SELECT unnest(['surface_grid_schema_version', 'surface_grid_hash', 'maturity_coordinate',
               'moneyness_coordinate']) AS column_name,
       unnest([0, count(*) FILTER (underlying_symbol = 'BBB'), 0, 0]) AS n_rows
FROM (SELECT DISTINCT underlying_symbol, quote_date FROM gold)""")(
    lambda run: contracts.check_grid_metadata(
        run.gold().withColumn("surface_grid_hash", F.when(
            F.col(N.SYMBOL) == "BBB", "other").otherwise(F.col("surface_grid_hash"))), run.grid))
register("infer_grid", "axis:s axis_index:i coordinate:d6 n_rows:i is_consistent:b", """
SELECT 'maturity' AS axis, maturity_index AS axis_index, maturity_days AS coordinate, count(*) AS n_rows,
       true AS is_consistent FROM gold GROUP BY ALL
UNION ALL SELECT 'moneyness', moneyness_index, moneyness_point, count(*), true FROM gold GROUP BY ALL""")(
    lambda run: contracts.infer_grid(surface.gold_rows(run.gold(), run.grid)))
register("check_dates_increasing", DAY + " n_rows:i", """
SELECT underlying_symbol, quote_date, count(*) AS n_rows FROM fc
WHERE cell_index = 0 GROUP BY ALL HAVING count(*) > 1""")(
    lambda run: contracts.check_dates_increasing(run.forecasts()))
register("check_target_alignment", DAY + " target_date:t expected_target_date:t", """
SELECT f.underlying_symbol, f.quote_date, f.target_date + 1 AS target_date,
       f.target_date AS expected_target_date
FROM feat f WHERE f.cell_index = 0 AND dayofmonth(f.quote_date) = 15""")(
    lambda run: contracts.check_target_alignment(
        run.features().withColumn(N.TARGET_DATE, F.when(
            F.dayofmonth(N.DATE) == 15, F.date_add(N.TARGET_DATE, 1)).otherwise(
            F.col(N.TARGET_DATE))), run.gold()))
register("check_mask_weights", MODEL_DAY + " n_unweighted:i weight_sum:d6", """
SELECT underlying_symbol, model_name, quote_date, target_date, count(*) AS n_unweighted, 0E0 AS weight_sum
FROM joined WHERE actual_observed_mask AND dayofmonth(target_date) = 15 GROUP BY ALL""")(
    lambda run: contracts.check_mask_weights(
        run.panel().withColumn("observed_weight", F.when(
            F.dayofmonth(N.TARGET_DATE) == 15, 0.0).otherwise(F.col("observed_weight"))),
        evaluate.DAY_KEY))

# ---- reports --------------------------------------------------------------------------

RANK_METRIC = f"mean_{MSE}"


def _ranked(run: Run) -> DataFrame:
    return report.ranked_loss(_summary(run), RANK_METRIC, BENCHMARK)


def _leaders(run: Run) -> DataFrame:
    return report.slice_leaders(_slices(run), "wrmse_total_variance", BENCHMARK)


def _tails(run: Run) -> DataFrame:
    return report.tail_risk(run.daily_loss(), MSE, BENCHMARK)


def _hedge_ranks(run: Run) -> DataFrame:
    return report.ranked_hedging(_hedge_summary(run), BENCHMARK)


register("ranked_loss", "underlying_symbol:s rank:i model_name:s mean_observed_mse_total_variance:d10 "
         "std_observed_mse_total_variance:d10 n_target_dates:i improvement_vs_benchmark_pct:d6", "ranks")(_ranked)
register("ranked_hedging", HEDGE_SUMMARY + " rank:i improvement_vs_benchmark_pct:d6", "hedge_ranks")(_hedge_ranks)
register("tail_risk", "underlying_symbol:s model_name:s mean_loss:d10 p90_loss:d10 p95_loss:d10 p99_loss:d10 "
         "max_loss:d10 p95_improvement_vs_benchmark_pct:d6 max_improvement_vs_benchmark_pct:d6 n_target_dates:i",
         "tails")(_tails)
register("worst_days", MODEL_DAY + " rank_within_model:i loss_value:d10 benchmark_loss_value:d10 "
         "excess_loss_vs_benchmark:d10 loss_ratio_vs_benchmark:d6", """
SELECT d.underlying_symbol, d.model_name, d.quote_date, d.target_date, d.r AS rank_within_model,
       d.observed_mse_total_variance AS loss_value, b.observed_mse_total_variance AS benchmark_loss_value,
       d.observed_mse_total_variance - b.observed_mse_total_variance AS excess_loss_vs_benchmark,
       CASE WHEN b.observed_mse_total_variance > 0
            THEN d.observed_mse_total_variance / b.observed_mse_total_variance END AS loss_ratio_vs_benchmark
FROM (SELECT *, row_number() OVER (PARTITION BY underlying_symbol, model_name
        ORDER BY observed_mse_total_variance DESC, quote_date, target_date) AS r FROM daily) d
JOIN daily b USING (underlying_symbol, quote_date, target_date)
WHERE d.r <= 5 AND b.model_name = 'naive'""")(
    lambda run: report.worst_days(run.daily_loss(), MSE, BENCHMARK))
register("slice_leaders", "underlying_symbol:s slice_family:s slice_label:s evaluation_scope:s "
         "best_model_name:s best_metric_value:d9 benchmark_metric_value:d9 improvement_vs_benchmark_pct:d6",
         "leaders")(_leaders)
register("cell_leaders", "underlying_symbol:s maturity_days:i moneyness_point:d4 best_model_name:s "
         "best_cell_mse:d10 benchmark_cell_mse:d10 improvement_vs_benchmark_pct:d6 n_observed_days:i "
         "benchmark_observed_days:i", """
SELECT c.underlying_symbol, c.maturity_days, c.moneyness_point, c.model_name AS best_model_name,
       c.mse AS best_cell_mse, b.mse AS benchmark_cell_mse, (b.mse - c.mse) / b.mse * 100
         AS improvement_vs_benchmark_pct, c.n AS n_observed_days, b.n AS benchmark_observed_days
FROM (SELECT *, row_number() OVER (PARTITION BY underlying_symbol, maturity_days, moneyness_point
        ORDER BY mse, model_name) AS r FROM cell_mses) c
JOIN cell_mses b USING (underlying_symbol, maturity_days, moneyness_point)
WHERE c.r = 1 AND b.model_name = 'naive'""")(
    lambda run: report.cell_leaders(run.panel(), BENCHMARK))
register("dm_table", SERIES + " p_rank:i model_b:s p_value:d9 statistic:d6", """
SELECT underlying_symbol, loss_metric, model_b, p_value, statistic,
       row_number() OVER (PARTITION BY underlying_symbol, loss_metric
                          ORDER BY greatest(least(p_value, 1), 0), model_b) AS p_rank FROM dm""")(
    lambda run: report.dm_table(compare.diebold_mariano(run.losses(), BENCHMARK, "greater", 2)))
register("spa_table", SERIES + " candidate_models:s observed_statistic:d6 p_value:d6 superior_models_by_mean:s", """
SELECT s.underlying_symbol, s.loss_metric, 'mean22,mean5' AS candidate_models, s.observed_statistic, s.p_value,
       coalesce((SELECT string_agg(model_b, ',' ORDER BY model_b) FROM spa_scale c
        WHERE c.underlying_symbol = s.underlying_symbol AND c.loss_metric = s.loss_metric AND c.mean_d > 0), '')
       AS superior_models_by_mean FROM spa s""")(lambda run: report.spa_table(_spa(run)))
register("mcs_table", SERIES + " model_name:s included_in_simplified_tmax_set:b simplified_tmax_alpha:d4", """
SELECT m.underlying_symbol, m.loss_metric, m.model_name, k.model_name IS NOT NULL
       AS included_in_simplified_tmax_set, 0.1E0 AS simplified_tmax_alpha
FROM model_means m LEFT JOIN kept k USING (underlying_symbol, loss_metric, model_name)""")(
    lambda run: report.mcs_table(_mcs(run), _summary(run)))
register("relative_ranking", "underlying_symbol:s model_name:s metric_value:d10 ratio_to_benchmark:d8 rank:i", """
SELECT underlying_symbol, model_name, mean_observed_mse_total_variance AS metric_value,
       mean_observed_mse_total_variance / base AS ratio_to_benchmark, rank FROM ranks""")(
    lambda run: report.relative_ranking(_summary(run), RANK_METRIC, BENCHMARK))
register("top_n", MODEL_DAY + " observed_mse_total_variance:d10", """
SELECT * FROM daily ORDER BY observed_mse_total_variance DESC, underlying_symbol, model_name, quote_date
LIMIT 25""")(
    lambda run: report.top_n(run.daily_loss(), 25, F.col(MSE).desc(), N.SYMBOL, "model_name", N.DATE))
register("ecdf", "underlying_symbol:s model_name:s loss_value:d9 cumulative_share:d8", """
SELECT underlying_symbol, model_name, observed_qlike_total_variance AS loss_value,
       row_number() OVER (PARTITION BY underlying_symbol, model_name ORDER BY observed_qlike_total_variance)
       / CAST(count(*) OVER (PARTITION BY underlying_symbol, model_name) AS DOUBLE) AS cumulative_share
FROM daily""")(lambda run: report.ecdf(run.daily_loss(), QLIKE))
register("ecdf_markers", "underlying_symbol:s model_name:s upper_median:d9 p95:d9 n_points:i", """
SELECT underlying_symbol, model_name, l[len(l) // 2 + 1] AS upper_median,
       l[CAST(least(len(l), ceil(len(l) * 0.95E0)) AS BIGINT)] AS p95, len(l) AS n_points
FROM (SELECT underlying_symbol, model_name, list(observed_qlike_total_variance
             ORDER BY observed_qlike_total_variance) AS l FROM daily GROUP BY ALL)""")(
    lambda run: report.ecdf_markers(report.ecdf(run.daily_loss(), QLIKE)))
register("slice_curves", "underlying_symbol:s model_name:s slice_label:s slice_value_float:d4 metric_value:d9", """
SELECT s.underlying_symbol, s.model_name, slice_label, slice_value_float, wrmse_total_variance AS metric_value
FROM sliced s JOIN ranks r ON r.underlying_symbol = s.underlying_symbol AND r.model_name = s.model_name
WHERE slice_family = 'maturity' AND evaluation_scope = 'observed' AND r.rank <= 2""")(
    lambda run: report.slice_curves(_slices(run), _ranked(run), "maturity", "observed",
                                    "wrmse_total_variance", 2))
register("report_overview", "underlying_symbol:s item:s label:s value:d6", """
SELECT underlying_symbol, 'best_loss' AS item, model_name AS label, mean_observed_mse_total_variance AS value
FROM ranks WHERE rank = 1
UNION ALL SELECT underlying_symbol, 'best_tail', model_name, p95_loss FROM tails
QUALIFY row_number() OVER (PARTITION BY underlying_symbol ORDER BY p95_loss, max_loss, mean_loss, model_name) = 1
UNION ALL SELECT underlying_symbol, 'best_hedging', model_name, mean_abs_revaluation_error
FROM hedge_ranks WHERE rank = 1
UNION ALL SELECT underlying_symbol, 'retained_model', model_name, 0.1E0 FROM kept
WHERE loss_metric = 'observed_mse_total_variance'
UNION ALL SELECT underlying_symbol, 'slice_gain', slice_family || '/' || slice_label || '/' || evaluation_scope
  || '/' || best_model_name, improvement_vs_benchmark_pct
FROM (SELECT *, row_number() OVER (PARTITION BY underlying_symbol ORDER BY improvement_vs_benchmark_pct DESC,
        slice_family, slice_label, evaluation_scope) AS r FROM leaders
      WHERE NOT isnan(improvement_vs_benchmark_pct)) WHERE r <= 5
UNION ALL SELECT underlying_symbol, 'completion_mean_rmse', 'all', avg(rmse_diff) FROM sensitive GROUP BY ALL
UNION ALL SELECT underlying_symbol, 'completion_max_abs', 'all', max(max_abs_diff) FROM sensitive GROUP BY ALL""")(
    lambda run: report.report_overview(
        _ranked(run), RANK_METRIC, _tails(run), _hedge_ranks(run),
        report.mcs_table(_mcs(run), _summary(run)).filter(F.col("loss_metric") == MSE),
        _leaders(run), surface.sensitivity_summary(_sensitivity(run))))

# ---- incremental refresh --------------------------------------------------------------

register("refresh_affected", FEATURE_SPEC, """
SELECT * FROM (""" + FEATURE_SQL + """)
JOIN (SELECT underlying_symbol, quote_date FROM
        (SELECT underlying_symbol, quote_date, max(CAST(hit AS INT)) OVER (PARTITION BY underlying_symbol
           ORDER BY quote_date ROWS BETWEEN 21 PRECEDING AND 1 FOLLOWING) AS near
         FROM (SELECT DISTINCT underlying_symbol, quote_date,
                      quote_date IN (DATE '1997-03-05', DATE '1999-07-14') AS hit FROM gold))
      WHERE near = 1) USING (underlying_symbol, quote_date)""")(
    lambda run: jobs.refresh_affected(
        run.gold().filter(F.col(N.DATE).isin(dt.date(1997, 3, 5), dt.date(1999, 7, 14))),
        run.gold(), run.grid))



@register("stream_observed_surface", DAY + " cell_index:i observed_total_variance:d9 vega_sum:d6 "
          "observation_count:i", """
SELECT underlying_symbol, quote_date, maturity_index * 5 + moneyness_index AS cell_index,
       observed_total_variance, vega_sum, observation_count
FROM cells_seen""")
def _streamed(run: Run) -> DataFrame:
    """The panel read as a stream until it is exhausted, with the days that are still open."""
    spark, name = run.tables.spark, "stream_source"
    source = run.tables.get(name, lambda: run.assigned().withColumn(
        "decision_ts", F.to_timestamp(N.DECISION_TS)))
    if "streamed" not in run.tables._written:
        stream = spark.readStream.schema(source.schema).parquet(run.tables.path(name))
        query = jobs.stream_observed_surface(stream, v.SETTINGS).writeStream.outputMode(
            "append").format("parquet").option("path", run.tables.path("streamed")).option(
            "checkpointLocation", run.tables.path("streamed_checkpoint")).trigger(
            availableNow=True).start()
        query.awaitTermination()
        run.tables._written.add("streamed")
    return spark.read.parquet(run.tables.path("streamed")).unionByName(
        jobs.open_days(spark, run.tables.path("streamed_checkpoint")))


# ---- fitted models: no SQL form -------------------------------------------------------

FITTED = ("underlying_symbol:s model_name:s quote_date:t target_date:t split_id:s cell_index:i "
          "predicted_total_variance:d8")


def _fitted(run: Run, plan: forecast.FitPlan) -> DataFrame:
    made = forecast.fit_forecasts(run.features(), run.boundary(), [plan], WALKFORWARD, run.grid,
                                  "run")
    return forecast.write_forecasts_long(made, run.grid)


register("forecast_ridge", FITTED)(lambda run: _fitted(run, PLANS[0]))
register("forecast_har_factor", FITTED)(lambda run: _fitted(run, PLANS[1]))
register("forecast_elasticnet", FITTED)(lambda run: _fitted(
    run, forecast.FitPlan("elasticnet", {"alpha": 0.01, "l1_ratio": 0.1})))
SWEEP = tuple(forecast.FitPlan("ridge", {"alpha": a}) for a in (0.1, 1.0, 10.0, 100.0)) + tuple(
    forecast.FitPlan("har_factor", {"n_factors": k, "alpha": a}) for k in (2, 5) for a in (1.0, 50.0))


def _scores(run: Run) -> DataFrame:
    return run.tables.get("sweep", lambda: forecast.sweep_scores(
        forecast.validation_forecasts(run.features(), SWEEP, WALKFORWARD, 3, run.grid),
        run.features()))


register("validation_sweep", "underlying_symbol:s model_name:s best_params:s best_score:d9 n_params:i "
         "n_splits:i")(lambda run: forecast.validation_sweep(_scores(run)))
register("quote_percentiles", "underlying_symbol:s option_type:s share:d3 value:d6 n:i", """
WITH wanted AS (SELECT unnest([0.05, 0.5, 0.95]) AS share),
     prices AS (SELECT underlying_symbol, option_type, CAST(bid_1545 AS DOUBLE) AS x FROM quotes
                WHERE isfinite(bid_1545)),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY underlying_symbol, option_type ORDER BY x) - 1 AS place,
                       count(*) OVER (PARTITION BY underlying_symbol, option_type) AS n FROM prices)
SELECT underlying_symbol, option_type, share,
       sum(x * (1 - abs((n - 1) * share - place))) AS value, any_value(n) AS n
FROM ranked, wanted WHERE place IN (floor((n - 1) * share), ceil((n - 1) * share))
GROUP BY ALL""")(lambda run: ranks.percentiles(
    run.tables, run.bronze().filter("abs(bid_1545) < double('infinity')"),
    (N.SYMBOL, "option_type"), "bid_1545", (0.05, 0.5, 0.95), "quote-percentiles"))
register("tuning_medians", "model_name:s median_observed_mse_total_variance:d9 n_rows:i")(
    lambda run: forecast.tuning_medians(_scores(run), (MSE, QLIKE), run.tables))




@register("check_sweep_policy", "underlying_symbol:s distinct_n_splits:i distinct_loss_metric:i "
          "distinct_max_hpo_validation_date:i distinct_first_clean_test_split_id:i", """
SELECT DISTINCT underlying_symbol, 2 AS distinct_n_splits, 1 AS distinct_loss_metric,
       1 AS distinct_max_hpo_validation_date, 1 AS distinct_first_clean_test_split_id
FROM edges WHERE underlying_symbol = 'BBB'""")
def _sweep_policy(run: Run) -> DataFrame:
    """The sweep's models with one underlying's record spoiled for one model."""
    swept = forecast.validation_sweep(_scores(run)).join(
        run.boundary().drop("n_splits"), N.SYMBOL).withColumn("loss_metric", F.lit(MSE))
    spoiled = (F.col(N.SYMBOL) == "BBB") & (F.col("model_name") == "ridge")
    return forecast.check_sweep_policy(swept.withColumn(
        "n_splits", F.col("n_splits") - spoiled.cast("int")))


BLOCKS = splits.WalkforwardSettings(504, 126, 504, 504)


def _pooled(run: Run, model: str, params: dict) -> DataFrame:
    """Pooled learners walk forward in two-year blocks over the same dates."""
    members = run.tables.get("block_splits", lambda: splits.walkforward_splits(
        run.features(), BLOCKS))
    made = pooled.pooled_forecasts(run.features(), members, model, "run", params, n_factors=3)
    return forecast.write_forecasts_long(made, run.grid)


@register("forecast_forest", FITTED)
def _forest(run: Run) -> DataFrame:
    """The multi-output forest on every clean split."""
    made = forest.forest_forecasts(
        run.tables, run.features(), splits.clean_splits(run.splits(), SETTINGS.tuning_splits), "run",
        forest.ForestSettings(n_trees=20, max_depth=6))
    return forecast.write_forecasts_long(made, run.grid)


register("forecast_boosted", FITTED)(lambda run: _pooled(
    run, "boosted", {"n_estimators": 20, "max_depth": 4}))
register("forecast_pooled_ridge", FITTED)(lambda run: _pooled(run, "pooled_ridge", {"alpha": 0.01}))
register("forecast_pooled_elasticnet", FITTED)(lambda run: _pooled(run, "pooled_elasticnet", {}))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
