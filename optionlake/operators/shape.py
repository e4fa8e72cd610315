"""Shape diagnostics and scores of surfaces held as cell arrays.

Neighbouring cells are lined up by shifting the array before it is opened, so no window and
no sort is needed; the per-surface sums combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions.grid import SurfaceGrid
from optionlake.functions.sqlmath import norm_cdf

ACTUAL_MODEL = "actual_surface"


def _shift(values: Column, by: int, n: int) -> Column:
    """Array moved by a number of places; positions without a source become NULL."""
    gap = F.array_repeat(F.lit(None).cast("double"), min(abs(by), n))
    if abs(by) >= n:
        return gap
    if by > 0:
        return F.concat(gap, F.slice(values, 1, n - by))
    return F.concat(F.slice(values, 1 - by, n + by), gap)


def cell_neighbours(surfaces: DataFrame, values: str, grid: SurfaceGrid,
                    keep: tuple[str, ...]) -> DataFrame:
    """One row per cell with the values left/right in moneyness, shorter/longer in maturity."""
    v, n, width = F.col(values), grid.n_cells, grid.n_moneyness
    zipped = F.arrays_zip(
        v.alias("w"), _shift(v, 1, n).alias("w_left"), _shift(v, -1, n).alias("w_right"),
        _shift(v, width, n).alias("w_shorter"), _shift(v, -width, n).alias("w_longer"))
    opened = surfaces.select(*keep, F.posexplode(zipped).alias("cell_index", "_c")).select(
        *keep, "cell_index",
        *[F.col("_c")[f].alias(f)
          for f in ("w", "w_left", "w_right", "w_shorter", "w_longer")])
    ki = grid.moneyness_index_of(F.col("cell_index"))
    inner = (ki > 0) & (ki < width - 1)
    return opened.withColumns({
        "_ki": ki.cast("int"),
        "w_left": F.when(inner, F.col("w_left")),
        "w_right": F.when(inner, F.col("w_right")),
    })


def _call_price(w: Column, m: Column, strike: Column) -> Column:
    """Black call price on a unit forward for total variance w and log-strike m."""
    root = F.sqrt(w)
    d1 = (w * 0.5 - m) / root
    return norm_cdf(d1) - strike * norm_cdf(d1 - root)


def with_curvature(cells: DataFrame, grid: SurfaceGrid) -> DataFrame:
    """Second difference of call prices over the uneven strike grid exp(m); NULL at the ends."""
    checked = cells.withColumn(
        "w", F.when(~(F.col("w") > 0.0) | F.isnan("w"),
                    F.raise_error("price diagnostics need positive total variance")
                    .cast("double")).otherwise(F.col("w")))
    coordinates = {}
    for side, step in (("left", -1), ("mid", 0), ("right", 1)):
        at = F.greatest(F.least(F.col("_ki") + step, F.lit(grid.n_moneyness - 1)), F.lit(0))
        coordinates[f"_m_{side}"] = grid.moneyness_at(at)
    placed = checked.withColumns(coordinates).withColumns(
        {f"_x_{side}": F.exp(f"_m_{side}") for side in ("left", "mid", "right")})
    priced = placed.withColumns({
        "_p_left": _call_price(F.col("w_left"), F.col("_m_left"), F.col("_x_left")),
        "_p_mid": _call_price(F.col("w"), F.col("_m_mid"), F.col("_x_mid")),
        "_p_right": _call_price(F.col("w_right"), F.col("_m_right"), F.col("_x_right")),
    })
    left = F.try_divide(F.col("_p_mid") - F.col("_p_left"), F.col("_x_mid") - F.col("_x_left"))
    right = F.try_divide(F.col("_p_right") - F.col("_p_mid"),
                         F.col("_x_right") - F.col("_x_mid"))
    curvature = F.try_divide((right - left) * 2.0, F.col("_x_right") - F.col("_x_left"))
    return priced.withColumn("curvature", curvature).drop(
        *[f"_{k}_{side}" for k in "mxp" for side in ("left", "mid", "right")])


def shape_diagnostics(surfaces: DataFrame, values: str, grid: SurfaceGrid,
                      keys: tuple[str, ...]) -> DataFrame:
    """Count and size of calendar and convexity violations per surface."""
    cells = with_curvature(cell_neighbours(surfaces, values, grid, keys), grid)
    drop = F.col("w") - F.col("w_shorter")
    return cells.groupBy(*keys).agg(
        F.count_if(drop < 0.0).alias("calendar_violation_count"),
        F.coalesce(F.sum(F.when(drop < 0.0, -drop)), F.lit(0.0))
        .alias("calendar_violation_magnitude"),
        F.count_if(F.col("curvature") < 0.0).alias("convexity_violation_count"),
        F.coalesce(F.sum(F.when(F.col("curvature") < 0.0, -F.col("curvature"))), F.lit(0.0))
        .alias("convexity_violation_magnitude"),
    )


def all_shape_diagnostics(forecast_days: DataFrame, gold_days: DataFrame,
                          grid: SurfaceGrid) -> DataFrame:
    """Diagnostics of every forecast surface and of the realised surfaces."""
    keys = (N.SYMBOL, "model_name", N.DATE, N.TARGET_DATE)
    actual = gold_days.select(
        N.SYMBOL, F.lit(ACTUAL_MODEL).alias("model_name"), N.DATE,
        F.col(N.DATE).alias(N.TARGET_DATE),
        F.col("completed_total_variance").alias("surface"))
    forecast = forecast_days.select(*keys, F.col("predictions").alias("surface"))
    return shape_diagnostics(forecast.unionByName(actual), "surface", grid, keys)


def diagnostic_summary(daily: DataFrame,
                       keys: tuple[str, ...] = (N.SYMBOL, "model_name")) -> DataFrame:
    measures = ("calendar_violation_count", "calendar_violation_magnitude",
                "convexity_violation_count", "convexity_violation_magnitude")
    return daily.groupBy(*keys).agg(
        *[F.avg(name).alias(f"mean_{name}") for name in measures],
        F.count(F.lit(1)).alias("n_surfaces"))


def shape_penalties(surfaces: DataFrame, values: str, grid: SurfaceGrid,
                    keys: tuple[str, ...]) -> DataFrame:
    """Mean calendar decrease, mean negative price curvature and mean squared roughness."""
    if grid.n_maturities < 3 or grid.n_moneyness < 3:
        raise ValueError("shape penalties need at least a 3 x 3 grid")
    cells = with_curvature(cell_neighbours(surfaces, values, grid, keys), grid)
    bend_t = F.col("w_longer") - F.col("w") * 2.0 + F.col("w_shorter")
    bend_m = F.col("w_right") - F.col("w") * 2.0 + F.col("w_left")
    zero = F.lit(0.0)
    return cells.groupBy(*keys).agg(
        F.avg(F.when(F.col("w_shorter").isNotNull(),
                     F.greatest(F.col("w_shorter") - F.col("w"), zero)))
        .alias("calendar_penalty"),
        F.avg(F.when(F.col("curvature").isNotNull(), F.greatest(-F.col("curvature"), zero)))
        .alias("convexity_penalty"),
        (F.avg(bend_t * bend_t) + F.avg(bend_m * bend_m)).alias("roughness_penalty"),
    )
