"""Revaluation and delta-vega hedging of a fixed option book.

Every trade (underlying, model, origin, target) carries its three surfaces as arrays. Its
instruments are opened in each valuation state, priced by column expressions and summed
back; the sums combine on the map side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions.grid import DAYS_PER_YEAR, SurfaceGrid
from optionlake.functions.sqlmath import (cdf_from_tail, count_at_or_below, norm_pdf,
                                           normal_tail)

DOMAIN_TOLERANCE = 1.0e-12
TRADE_KEY = (N.SYMBOL, "model_name", N.DATE, N.TARGET_DATE)
NOW, PREDICTED, REALISED, SIZING = "t0_actual", "t1_predicted", "t1_actual", "sizing"


@dataclass(frozen=True)
class HedgeSettings:
    rate: float = 0.0
    level_notional: float = 1.0
    skew_notional: float = 1.0
    calendar_notional: float = 0.5
    skew_moneyness_abs: float = 0.10
    short_maturity_days: int = 30
    long_maturity_days: int = 90
    hedge_maturity_days: int = 30
    hedge_straddle_moneyness: float = 0.0
    hedge_vega_floor: float = 1.0e-12

    def book(self) -> list[tuple[str, str, float, float, int]]:
        """(label, type, quantity, log-strike shift, maturity) of the eight positions."""
        short, long = self.short_maturity_days, self.long_maturity_days
        level, skew, cal = self.level_notional, self.skew_notional, self.calendar_notional
        wing = self.skew_moneyness_abs
        return [
            ("atm_call_long", "C", level, 0.0, short),
            ("atm_put_long", "P", level, 0.0, short),
            ("rr_put_long", "P", skew, -wing, short),
            ("rr_call_short", "C", -skew, wing, short),
            ("cal_call_long", "C", cal, 0.0, long),
            ("cal_call_short", "C", -cal, 0.0, short),
            ("cal_put_long", "P", cal, 0.0, long),
            ("cal_put_short", "P", -cal, 0.0, short),
        ]

    def hedge(self) -> list[tuple[str, str, float, float, int]]:
        shift, days = self.hedge_straddle_moneyness, self.hedge_maturity_days
        return [("hedge_call", "C", 1.0, shift, days), ("hedge_put", "P", 1.0, shift, days)]


def _instrument(row: tuple[str, str, float, float, int], *extra: Column) -> Column:
    label, kind, quantity, shift, days = row
    return F.struct(
        F.lit(label).alias("label"), F.lit(kind).alias("option_type"),
        F.lit(float(quantity)).alias("quantity"), F.lit(float(shift)).alias("shift"),
        F.lit(int(days)).alias("initial_maturity_days"), *extra)


def standard_book(spots: DataFrame, settings: HedgeSettings = HedgeSettings()) -> DataFrame:
    """The eight book positions of every underlying and trade date."""
    rows = F.array(*[_instrument(r) for r in settings.book()])
    opened = spots.select(*N.DAY, "spot", F.explode(rows).alias("i"))
    strike = F.when(F.col("i.shift") == 0.0, F.col("spot")).otherwise(
        F.col("spot") * F.exp("i.shift"))
    return opened.select(
        *N.DAY, "i.label", "i.option_type", "i.quantity", strike.alias("strike"),
        "i.initial_maturity_days")


def snap(value: Column, low: float, high: float) -> Column:
    """The value inside a closed domain, forgiving round-off at its ends; else NULL."""
    return (
        F.when((value >= low) & (value <= high), value)
        .when(F.abs(value - low) <= DOMAIN_TOLERANCE, F.lit(float(low)))
        .when(F.abs(value - high) <= DOMAIN_TOLERANCE, F.lit(float(high)))
    )


def add_sigma(df: DataFrame, surface: str, days: str, log_moneyness: str, grid: SurfaceGrid,
              strict: bool = True, output: str = "sigma") -> DataFrame:
    """Bilinear total variance at (days, log-moneyness) turned into a volatility.

    The four corners are picked from the surface array by position, so nothing is joined.
    Coordinates outside the grid raise in strict mode and give NULL otherwise.
    """
    if grid.n_maturities < 2 or grid.n_moneyness < 2:
        raise ValueError("interpolation needs at least two points on each axis")
    axis_days = [float(d) for d in grid.maturity_days]
    axis_m = list(grid.moneyness_points)

    def lower(value: Column, axis: list[float]) -> Column:
        inner = count_at_or_below(value, axis) - 1
        return F.greatest(F.least(inner, F.lit(len(axis) - 2)), F.lit(0))

    placed = df.withColumns({
        "_t": snap(F.col(days).cast("double"), axis_days[0], axis_days[-1]),
        "_m": snap(F.col(log_moneyness), axis_m[0], axis_m[-1]),
    }).withColumns({"_ti": lower(F.col("_t"), axis_days), "_mi": lower(F.col("_m"), axis_m)})

    def weight(value: str, index: str, axis: list[float]) -> Column:
        points = F.array(*[F.lit(v) for v in axis])
        x0, x1 = F.get(points, F.col(index)), F.get(points, F.col(index) + 1)
        return (F.col(value) - x0) / (x1 - x0)

    weighed = placed.withColumns({"_tw": weight("_t", "_ti", axis_days),
                                  "_mw": weight("_m", "_mi", axis_m)})

    def corner(dt: int, dm: int) -> Column:
        position = (F.col("_ti") + dt) * grid.n_moneyness + F.col("_mi") + dm
        return F.get(F.col(surface), position.cast("int"))

    one = F.lit(1.0)
    t, m = F.col("_tw"), F.col("_mw")
    w = (corner(0, 0) * (one - t) * (one - m) + corner(0, 1) * (one - t) * m
         + corner(1, 0) * t * (one - m) + corner(1, 1) * t * m)
    sigma = F.sqrt(F.col("_w") / F.greatest(F.col("_t") / DAYS_PER_YEAR, F.lit(1.0e-12)))
    outside = F.col("_t").isNull() | F.col("_m").isNull()
    bad = F.raise_error(F.concat(
        F.lit("outside the surface domain: days="), F.col(days).cast("string"),
        F.lit(" log_moneyness="), F.col(log_moneyness).cast("string"))).cast("double") \
        if strict else F.lit(None).cast("double")
    return weighed.withColumn("_w", w).withColumn(
        output, F.when(outside, bad).otherwise(sigma)).drop(
        "_t", "_m", "_ti", "_mi", "_tw", "_mw", "_w")


def add_black_scholes(df: DataFrame, rate: float = 0.0) -> DataFrame:
    """Unit price, delta and vega from spot, strike, tau_years, sigma and option_type.

    Expired or zero-volatility options are worth their intrinsic value with zero vega.
    """
    s, k, tau, sigma = (F.col(c) for c in ("spot", "strike", "tau_years", "sigma"))
    call = F.col("option_type") == "C"
    live = (tau > 0.0) & (sigma > 0.0)
    width = sigma * F.sqrt(tau)
    d1 = (F.ln(s / k) + (F.lit(rate) + sigma * sigma * 0.5) * tau) / width
    staged = df.withColumn("_width", F.when(live, width)).withColumn(
        "_d1", F.when(live, d1)).withColumn("_d2", F.col("_d1") - F.col("_width")).withColumns({
            "_tail1": normal_tail("_d1"), "_tail2": normal_tail("_d2"),
            "_disc": F.exp(-F.lit(rate) * tau)})
    disc = F.col("_disc")
    n1, minus1 = cdf_from_tail("_d1", "_tail1"), cdf_from_tail(-F.col("_d1"), "_tail1")
    n2, minus2 = cdf_from_tail("_d2", "_tail2"), cdf_from_tail(-F.col("_d2"), "_tail2")
    price = F.when(
        ~live, F.greatest(F.when(call, s - k).otherwise(k - s), F.lit(0.0))
    ).when(call, s * n1 - k * disc * n2).otherwise(k * disc * minus2 - s * minus1)
    delta = F.when(~live & call, F.when(s > k, 1.0).otherwise(0.0)).when(
        ~live, F.when(s < k, -1.0).otherwise(0.0)).when(call, n1).otherwise(n1 - 1.0)
    vega = F.when(live, s * norm_pdf("_d1") * F.sqrt(tau)).otherwise(0.0)
    return staged.withColumns({"price": price, "delta": delta, "vega": vega}).drop(
        "_width", "_d1", "_d2", "_tail1", "_tail2", "_disc")


def value_instruments(trades: DataFrame, grid: SurfaceGrid,
                      settings: HedgeSettings = HedgeSettings(),
                      strict: bool = True) -> DataFrame:
    """Every position of every trade in each state it is valued in.

    `trades` carries spot_t, spot_t1 and the arrays predicted, actual_t and actual_t1. The
    hedge straddle is not valued on the predicted surface at the realised spot.
    """
    entries = []
    for rows, states, is_hedge in ((settings.book(), (NOW, PREDICTED, REALISED, SIZING), False),
                                   (settings.hedge(), (NOW, REALISED, SIZING), True)):
        entries += [_instrument(r, F.lit(s).alias("state"), F.lit(is_hedge).alias("is_hedge"))
                    for r in rows for s in states]
    opened = trades.withColumn("_i", F.explode(F.array(*entries)))
    state = F.col("_i.state")
    surface = F.when(state == NOW, F.col("actual_t")).when(
        state == REALISED, F.col("actual_t1")).otherwise(F.col("predicted"))
    spot = F.when(state.isin(NOW, SIZING), F.col("spot_t")).otherwise(F.col("spot_t1"))
    elapsed = F.when(state == NOW, 0).otherwise(F.datediff(N.TARGET_DATE, N.DATE))
    rows = opened.select(
        *TRADE_KEY, "_i.label", "_i.option_type", "_i.quantity", "_i.is_hedge",
        state.alias("state"), surface.alias("_surface"), spot.alias("spot"),
        (F.col("spot_t") * F.exp("_i.shift")).alias("strike"),
        (F.col("_i.initial_maturity_days") - elapsed).alias("remaining_days"))
    placed = rows.withColumns({
        "log_moneyness": F.ln(F.col("strike") / F.col("spot")),
        "tau_years": F.greatest(F.col("remaining_days") / DAYS_PER_YEAR, F.lit(0.0))})
    priced = add_black_scholes(
        add_sigma(placed, "_surface", "remaining_days", "log_moneyness", grid, strict),
        settings.rate)
    q = F.col("quantity")
    return priced.drop("_surface").withColumns({
        "price": F.col("price") * q, "delta": F.col("delta") * q, "vega": F.col("vega") * q})


def value_book(valued: DataFrame) -> DataFrame:
    """Book value, delta and vega per trade and state."""
    return valued.filter(~F.col("is_hedge")).groupBy(*TRADE_KEY, "state").agg(
        F.sum("price").alias("total_value"), F.sum("delta").alias("total_delta"),
        F.sum("vega").alias("total_vega"))


def hedge_trades(forecast_days: DataFrame, gold_days: DataFrame, spots: DataFrame) -> DataFrame:
    """Trades with their surfaces and spots: three equi-joins on day keys.

    A forecast whose origin or target day has no surface or spot is an error, never dropped.
    """
    states = gold_days.select(*N.DAY, "completed_total_variance").join(
        spots.select(*N.DAY, "spot"), list(N.DAY), "inner")
    origin = states.select(*N.DAY, F.col("spot").alias("spot_t"),
                           F.col("completed_total_variance").alias("actual_t"))
    target = states.select(N.SYMBOL, F.col(N.DATE).alias(N.TARGET_DATE),
                           F.col("spot").alias("spot_t1"),
                           F.col("completed_total_variance").alias("actual_t1"))
    return forecast_days.select(*TRADE_KEY, F.col("predictions").alias("predicted")).join(
        origin, list(N.DAY), "left").join(target, [N.SYMBOL, N.TARGET_DATE], "left").select(
            *TRADE_KEY, "predicted", *(_present(c) for c in (
                "spot_t", "actual_t", "spot_t1", "actual_t1")))


def _present(column: str) -> Column:
    return F.when(F.col(column).isNull(), F.raise_error(F.lit(
        f"a forecast day has no {column}"))).otherwise(F.col(column)).alias(column)


def _hedge_sums(valued: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    def total(column: str, state: str, hedge: bool) -> Column:
        here = (F.col("state") == state) & (F.col("is_hedge") == F.lit(hedge))
        return F.sum(F.when(here, F.col(column)))

    return valued.groupBy(*TRADE_KEY).agg(
        F.max(F.when(F.col("state") == NOW, F.col("spot"))).alias("spot_t"),
        F.max(F.when(F.col("state") == REALISED, F.col("spot"))).alias("spot_t1"),
        total("price", NOW, False).alias("book_value_t0"),
        total("price", PREDICTED, False).alias("predicted_book_value_t1"),
        total("price", REALISED, False).alias("actual_book_value_t1"),
        total("price", NOW, True).alias("_straddle_t0"),
        total("price", REALISED, True).alias("_straddle_t1"),
        total("delta", SIZING, False).alias("_book_delta"),
        total("vega", SIZING, False).alias("_book_vega"),
        total("delta", SIZING, True).alias("_straddle_delta"),
        total("vega", SIZING, True).alias("_straddle_vega"))


def delta_vega_hedge(sums: DataFrame, vega_floor: float = 1.0e-12) -> DataFrame:
    """Straddle and underlying quantities that neutralise predicted vega and delta."""
    vega = F.col("_straddle_vega")
    feasible = F.coalesce((F.abs(vega) >= vega_floor) & (F.abs(vega) < float("inf"))
                          & F.lit(vega_floor > 0.0), F.lit(False))
    q = F.when(F.col("hedge_status") == "ok", -F.col("_book_vega") / vega)
    return sums.withColumn("hedge_status", F.when(feasible, "ok").otherwise("infeasible")) \
        .withColumn("straddle_quantity", q).withColumn(
            "underlying_quantity",
            -(F.col("_book_delta") + F.col("straddle_quantity") * F.col("_straddle_delta"))
    ).withColumns({
        "predicted_net_delta": F.col("_book_delta") + F.col("underlying_quantity")
        + F.col("straddle_quantity") * F.col("_straddle_delta"),
        "predicted_net_vega": F.col("_book_vega") + F.col("straddle_quantity") * vega})


def evaluate_hedging(trades: DataFrame, grid: SurfaceGrid,
                     settings: HedgeSettings = HedgeSettings(),
                     strict: bool = True) -> DataFrame:
    """Revaluation error, hedge sizes and unhedged/hedged PnL per trade."""
    valued = value_instruments(trades, grid, settings, strict)
    sized = delta_vega_hedge(_hedge_sums(valued), settings.hedge_vega_floor)
    if strict:
        sized = sized.withColumn("hedge_status", F.when(
            F.col("hedge_status") != "ok", F.raise_error("infeasible delta-vega hedge")
            .cast("string")).otherwise(F.col("hedge_status")))
    error = F.col("predicted_book_value_t1") - F.col("actual_book_value_t1")
    unhedged = F.col("actual_book_value_t1") - F.col("book_value_t0")
    hedged = (F.col("unhedged_pnl")
              + F.col("straddle_quantity") * (F.col("_straddle_t1") - F.col("_straddle_t0"))
              + F.col("underlying_quantity") * (F.col("spot_t1") - F.col("spot_t")))
    pnl = F.col("hedged_pnl")
    return sized.withColumns({"revaluation_error": error, "unhedged_pnl": unhedged}).withColumn(
        "hedged_pnl", hedged).select(
        *TRADE_KEY, "spot_t", "spot_t1", "book_value_t0", "predicted_book_value_t1",
        "actual_book_value_t1", "revaluation_error",
        F.abs("revaluation_error").alias("abs_revaluation_error"),
        (F.col("revaluation_error") * F.col("revaluation_error"))
        .alias("squared_revaluation_error"),
        "hedge_status", "underlying_quantity", "straddle_quantity", "predicted_net_delta",
        "predicted_net_vega", "unhedged_pnl", "hedged_pnl", F.abs(pnl).alias("abs_hedged_pnl"),
        (pnl * pnl).alias("squared_hedged_pnl"))


def hedging_summary(results: DataFrame) -> DataFrame:
    return results.groupBy(N.SYMBOL, "model_name").agg(
        F.avg("abs_revaluation_error").alias("mean_abs_revaluation_error"),
        F.avg("squared_revaluation_error").alias("mean_squared_revaluation_error"),
        F.avg("abs_hedged_pnl").alias("mean_abs_hedged_pnl"),
        F.avg("squared_hedged_pnl").alias("mean_squared_hedged_pnl"),
        F.var_samp("hedged_pnl").alias("hedged_pnl_variance"),
        F.count(F.lit(1)).alias("n_trades"))


def check_hedge_config(settings: HedgeSettings, grid: SurfaceGrid, max_gap_days: int) -> None:
    """Maturities, also after the largest gap, and strikes must fit the grid."""
    if max_gap_days <= 0:
        raise ValueError("max_gap_days must be positive")
    low, high = grid.maturity_days[0], grid.maturity_days[-1]
    for days in (settings.short_maturity_days, settings.long_maturity_days,
                 settings.hedge_maturity_days):
        for value in (days, days - max_gap_days):
            if not low <= value <= high:
                raise ValueError(f"maturity {value} leaves the grid [{low}, {high}]")
    low_m, high_m = grid.moneyness_points[0], grid.moneyness_points[-1]
    for m in (settings.skew_moneyness_abs, -settings.skew_moneyness_abs,
              settings.hedge_straddle_moneyness):
        if not low_m <= m <= high_m:
            raise ValueError(f"moneyness {m} leaves the grid [{low_m}, {high_m}]")


def check_hedge_domain(paths: DataFrame, spots: DataFrame, grid: SurfaceGrid,
                       settings: HedgeSettings = HedgeSettings()) -> DataFrame:
    """Paths on which a carried strike or maturity leaves the grid, or a spot is unusable."""
    distinct = paths.select(N.SYMBOL, N.DATE, N.TARGET_DATE).distinct()
    t0 = spots.select(*N.DAY, F.col("spot").alias("spot_t"))
    t1 = spots.select(N.SYMBOL, F.col(N.DATE).alias(N.TARGET_DATE),
                      F.col("spot").alias("spot_t1"))
    moved = distinct.join(t0, list(N.DAY), "left").join(t1, [N.SYMBOL, N.TARGET_DATE], "left")
    usable = F.coalesce((F.col("spot_t") > 0.0) & (F.col("spot_t1") > 0.0), F.lit(False))
    shift = F.when(usable, F.ln(F.col("spot_t") / F.col("spot_t1")))
    elapsed = F.datediff(N.TARGET_DATE, N.DATE)
    def check(name: str, value: Column, is_moneyness: bool) -> Column:
        return F.struct(F.lit(name).alias("field_name"), value.cast("double").alias("value"),
                        F.lit(is_moneyness).alias("is_moneyness"))

    wing = settings.skew_moneyness_abs
    checks = [check(f"{name}_target_log_moneyness", F.lit(float(m)) + F.col("_shift"), True)
              for name, m in (("atm", 0.0), ("rr_put", -wing), ("rr_call", wing),
                              ("hedge_straddle", settings.hedge_straddle_moneyness))]
    checks += [check(f"{name}_maturity_days_after_gap", F.lit(days) - elapsed, False)
               for name, days in (("short", settings.short_maturity_days),
                                  ("long", settings.long_maturity_days),
                                  ("hedge", settings.hedge_maturity_days))]
    opened = moved.withColumn("_shift", shift).select(
        N.SYMBOL, N.DATE, N.TARGET_DATE, F.explode(F.array(*checks)).alias("c")).select(
        N.SYMBOL, N.DATE, N.TARGET_DATE, "c.*")
    inside = F.when(
        F.col("is_moneyness"),
        snap(F.col("value"), grid.moneyness_points[0], grid.moneyness_points[-1])
    ).otherwise(snap(F.col("value"), float(grid.maturity_days[0]),
                     float(grid.maturity_days[-1])))
    return opened.filter(inside.isNull()).drop("is_moneyness")


def check_hedge_coverage(results: DataFrame, forecast_days: DataFrame) -> DataFrame:
    """Trades without a result and results without a forecast: two anti-joins."""
    expected, found = forecast_days.select(*TRADE_KEY), results.select(*TRADE_KEY)
    missing = expected.join(found, list(TRADE_KEY), "left_anti").withColumn(
        "violation", F.lit("MISSING"))
    extra = found.join(expected, list(TRADE_KEY), "left_anti").withColumn(
        "violation", F.lit("UNEXPECTED"))
    return missing.unionByName(extra)


def check_hedge_summary(summary: DataFrame, results: DataFrame,
                        tolerance: float = 1.0e-12) -> DataFrame:
    """Summary rows that differ from a recomputation by more than the tolerance."""
    again = hedging_summary(results)
    measures = [c for c in again.columns if c not in (N.SYMBOL, "model_name")]
    renamed = again.select(N.SYMBOL, "model_name",
                           *[F.col(c).alias(f"recomputed_{c}") for c in measures])
    joined = summary.join(renamed, [N.SYMBOL, "model_name"], "full")
    agrees = F.lit(True)
    for c in measures:
        a, b = F.col(c).cast("double"), F.col(f"recomputed_{c}").cast("double")
        close = F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
        agrees = agrees & (F.coalesce(close, F.lit(False)) | (a.isNull() & b.isNull()))
    return joined.filter(~agrees)
