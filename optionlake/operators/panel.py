"""Row classification: derived quote fields, quality reasons and grid cells."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions.grid import SurfaceGrid
from optionlake.functions.sqlmath import count_at_or_below, is_finite, not_finite, safe_ln

SURFACE_INPUT_COLUMNS = ("tau_years", "log_moneyness", "total_variance",
                         "implied_volatility_1545", "vega_1545", "spread_1545")
POSITIVE_SURFACE_INPUTS = ("tau_years", "total_variance", "implied_volatility_1545", "vega_1545")


@dataclass(frozen=True)
class CleaningRules:
    allowed_option_types: tuple[str, ...] = ("C", "P")
    min_bid_exclusive: float = 0.0
    min_ask_exclusive: float = 0.0
    min_mid_exclusive: float = 0.0
    require_ask_ge_bid: bool = True
    require_positive_iv: bool = True
    require_positive_vega: bool = True
    require_positive_underlying: bool = True
    max_abs_log_moneyness: float = 0.5
    min_tau_years: float = 0.0001
    max_tau_years: float = 2.5


def add_derived_fields(panel: DataFrame, log_moneyness: Column | None = None) -> DataFrame:
    """Mid, spread, log-moneyness and total variance of quotes that carry tau_years."""
    moneyness = (
        safe_ln("strike") - safe_ln("active_underlying_price_1545")
        if log_moneyness is None else log_moneyness
    )
    iv = F.col("implied_volatility_1545")
    return panel.withColumns({
        "mid_1545": (F.col("bid_1545") + F.col("ask_1545")) / 2.0,
        "spread_1545": F.col("ask_1545") - F.col("bid_1545"),
        "log_moneyness": moneyness,
        "total_variance": iv * iv * F.col("tau_years"),
    })


def join_tau(panel: DataFrame, tau: DataFrame) -> DataFrame:
    """Left join of a (day, root, expiration) -> tau_years table, many quotes to one."""
    keys = [N.DATE, "root", "expiration"]
    return panel.join(tau.select(*keys, "tau_years"), keys, "left")


def reason_rules(rules: CleaningRules = CleaningRules()) -> list[tuple[str, Column]]:
    """Ordered (code, condition) pairs; the first condition that holds names the row."""
    c = F.col
    finite_names = {"implied_volatility_1545": "IV_1545",
                    "active_underlying_price_1545": "UNDERLYING_1545"}

    def missing(*columns: str) -> list[tuple[str, Column]]:
        return [("MISSING_" + name.upper(), c(name).isNull()) for name in columns]

    def nonfinite(*columns: str) -> list[tuple[str, Column]]:
        return [("NONFINITE_" + finite_names.get(name, name.upper()), ~is_finite(name))
                for name in columns]

    ordered = missing("option_type", "bid_1545", "ask_1545", "implied_volatility_1545",
                      "vega_1545", "active_underlying_price_1545", "strike", "mid_1545",
                      "tau_years", "total_variance")
    ordered += nonfinite("bid_1545", "ask_1545", "implied_volatility_1545", "vega_1545",
                         "active_underlying_price_1545", "strike")
    ordered.append(("NON_POSITIVE_STRIKE", c("strike") <= 0.0))
    ordered += nonfinite("mid_1545", "tau_years", "total_variance")
    ordered += [
        ("INVALID_OPTION_TYPE", ~c("option_type").isin(*rules.allowed_option_types)),
        ("NON_POSITIVE_BID", c("bid_1545") <= rules.min_bid_exclusive),
        ("NON_POSITIVE_ASK", c("ask_1545") <= rules.min_ask_exclusive),
    ]
    if rules.require_ask_ge_bid:
        ordered.append(("ASK_LT_BID", c("ask_1545") < c("bid_1545")))
    if rules.require_positive_iv:
        ordered.append(("NON_POSITIVE_IV", c("implied_volatility_1545") <= 0.0))
    if rules.require_positive_vega:
        ordered.append(("NON_POSITIVE_VEGA", c("vega_1545") <= 0.0))
    if rules.require_positive_underlying:
        ordered.append(("NON_POSITIVE_UNDERLYING_PRICE",
                        c("active_underlying_price_1545") <= 0.0))
    ordered += [
        ("NON_POSITIVE_MID", c("mid_1545") <= rules.min_mid_exclusive),
        ("TAU_TOO_SHORT", c("tau_years") < rules.min_tau_years),
        ("TAU_TOO_LONG", c("tau_years") > rules.max_tau_years),
        ("NON_POSITIVE_TOTAL_VARIANCE", c("total_variance") <= 0.0),
        ("MISSING_LOG_MONEYNESS", c("log_moneyness").isNull()),
        ("NONFINITE_LOG_MONEYNESS", ~is_finite("log_moneyness")),
        ("OUTSIDE_MONEYNESS_RANGE", F.abs(c("log_moneyness")) > rules.max_abs_log_moneyness),
    ]
    return ordered


def flag_quality(panel: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Give every quote a reason code, or NULL when it is usable; no row is dropped."""
    (code, condition), *rest = reason_rules(rules)
    reason = reduce(lambda chain, rule: chain.when(rule[1], rule[0]), rest,
                    F.when(condition, code))
    return panel.withColumn("invalid_reason", reason).withColumn(
        "is_valid_observation", F.col("invalid_reason").isNull())


def valid_rows(panel: DataFrame) -> DataFrame:
    return panel.filter(F.col("is_valid_observation"))


def in_sample_window(df: DataFrame, start: dt.date, end: dt.date,
                     date_column: str = N.DATE) -> DataFrame:
    """Rows dated inside the closed window; a plain range that reaches the parquet scan."""
    return df.filter(F.col(date_column).between(F.lit(start), F.lit(end)))


def broken_inputs() -> Column:
    """A missing or non-finite surface input, or one that must be positive and is not."""
    broken = [not_finite(name) for name in SURFACE_INPUT_COLUMNS]
    broken += [F.coalesce(F.col(name) <= 0.0, F.lit(True)) for name in POSITIVE_SURFACE_INPUTS]
    return reduce(lambda a, b: a | b, broken)


def surface_inputs_guard(valid: DataFrame) -> DataFrame:
    """Valid-flagged rows that still carry a missing, non-finite or non-positive input."""
    return valid.filter(broken_inputs())


def assign_grid_cell(rows: DataFrame, grid: SurfaceGrid) -> DataFrame:
    """Nearest grid cell by midpoint edges (a value on an edge goes up), or a domain reason."""
    tau, m = F.col("tau_years"), F.col("log_moneyness")
    years, points = grid.maturity_years, grid.moneyness_points
    tau_ok = F.coalesce(is_finite(tau), F.lit(False))
    m_ok = F.coalesce(is_finite(m), F.lit(False))
    tagged = rows.withColumns({
        "inside_maturity_grid_domain": tau_ok & F.coalesce(
            (tau >= years[0]) & (tau <= years[-1]), F.lit(False)),
        "inside_moneyness_grid_domain": m_ok & F.coalesce(
            (m >= points[0]) & (m <= points[-1]), F.lit(False)),
    })
    in_tau, in_m = F.col("inside_maturity_grid_domain"), F.col("inside_moneyness_grid_domain")
    reason = (
        F.when(in_tau & in_m, "VALID_GRID_DOMAIN")
        .when(~tau_ok & ~m_ok, "NONFINITE_MATURITY_AND_MONEYNESS_GRID_COORDINATE")
        .when(~tau_ok, "NONFINITE_MATURITY_GRID_COORDINATE")
        .when(~m_ok, "NONFINITE_MONEYNESS_GRID_COORDINATE")
        .when(~in_tau & ~in_m, "OUTSIDE_MATURITY_AND_MONEYNESS_GRID_DOMAIN")
        .when(~in_tau, "OUTSIDE_MATURITY_GRID_DOMAIN")
        .otherwise("OUTSIDE_MONEYNESS_GRID_DOMAIN")
    )
    inside = in_tau & in_m
    return tagged.withColumns({
        "inside_grid_domain": inside,
        "grid_domain_reason": reason,
        "maturity_index": F.when(
            inside, count_at_or_below(tau, grid.maturity_edges).cast("long")),
        "moneyness_index": F.when(
            inside, count_at_or_below(m, grid.moneyness_edges).cast("long")),
    })


def reason_counts(panel: DataFrame, reason_column: str = "invalid_reason",
                  keys: tuple[str, ...] = N.DAY) -> DataFrame:
    """Rows per key and reason; NULL counts as VALID."""
    return panel.groupBy(
        *keys, F.coalesce(F.col(reason_column), F.lit("VALID")).alias("reason")
    ).agg(F.count(F.lit(1)).alias("n_rows"))


def spot_daily(panel: DataFrame) -> DataFrame:
    """Median valid underlying price per day with its spread of quotes.

    Prices are counted per distinct value first, so a day with very many quotes reaches the
    exact median as a short list of weighted prices.
    """
    price = F.col("active_underlying_price_1545")
    counted = valid_rows(panel).groupBy(*N.DAY, price.alias("price")).agg(
        F.count(F.lit(1)).alias("weight"))
    return spot_of_prices(counted)


def spot_of_prices(counted: DataFrame) -> DataFrame:
    """``spot_daily`` from (day, price, weight), each price of a day once."""
    spot = F.percentile(F.col("price"), F.lit(0.5), F.col("weight"))
    daily = counted.groupBy(*N.DAY).agg(
        spot.alias("spot"),
        F.sum("weight").alias("spot_row_count"),
        F.count(F.lit(1)).alias("spot_distinct_count"),
        F.min("price").alias("spot_min"),
        F.max("price").alias("spot_max"),
        F.max(not_finite("price") | (F.col("price") <= 0.0)).alias("_bad"),
    )
    return daily.withColumn(
        "spot",
        F.when(F.col("_bad"), F.raise_error("spot prices must be finite and positive")
               .cast("double")).otherwise(F.col("spot")),
    ).drop("_bad")
