"""From classified quotes to one completed surface per underlying and day.

A surface travels as one row of cell arrays in `cell_index` order (maturity-major), so that
joins and stage tables move one row per day instead of one row per cell. `dense_rows` opens
the arrays into the long one-row-per-cell layout without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions.grid import SurfaceGrid, SurfaceSettings
from optionlake.functions.sqlmath import doubles, ratio, total_variance_to_iv
from optionlake.operators.completion import complete, status_names
from optionlake.operators.panel import assign_grid_cell, broken_inputs

CELL_ARRAYS = ("observed_total_variance", "observed_iv", "weighted_spread_1545", "vega_sum",
               "observation_count", "observed_mask")
COMPLETED_ARRAYS = CELL_ARRAYS + ("completed_total_variance", "completed_iv",
                                  "completion_status")


def observed_cells(assigned: DataFrame, settings: SurfaceSettings) -> DataFrame:
    """Vega-weighted means of the quotes in each cell that has any.

    All sums combine on the map side, so a day that holds most of the quotes reaches the
    shuffle as at most one partial row per cell and task. The decision timestamp is a grouping
    key (it depends on the day) because a max over text would force a sort of every quote.
    """
    vega = F.col("vega_1545")

    def weighted(name: str) -> Column:
        return ratio(F.sum(F.col(name) * vega), F.sum(vega))

    inside = assigned.filter(F.col("inside_grid_domain"))
    cell = settings.grid.cell_index(F.col("maturity_index"), F.col("moneyness_index"))
    return inside.groupBy(*N.DAY, N.DECISION_TS, cell.alias("cell_index")).agg(
        weighted("total_variance").alias("observed_total_variance"),
        weighted("implied_volatility_1545").alias("observed_iv"),
        weighted("spread_1545").alias("weighted_spread_1545"),
        F.sum(vega).alias("vega_sum"),
        F.count(F.lit(1)).alias("observation_count"),
    ).withColumn("observed_mask",
                 F.col("observation_count") >= settings.observed_cell_min_count)


def quote_sums(flagged: DataFrame, grid: SurfaceGrid) -> DataFrame:
    """Sums of the usable quotes per day, cell (NULL outside the grid) and underlying price.

    ``flagged`` holds all quotes; those that are not usable are one row a day without cell and price.
    Usability is a grouping value instead of a filter: a filter would be pushed below the derived
    columns, with all of their expressions written out again in each of its conditions.
    """
    usable, vega = F.col("is_valid_observation"), F.col("vega_1545")
    cell = grid.cell_index(F.col("maturity_index"), F.col("moneyness_index"))
    tagged = assign_grid_cell(flagged, grid)
    keyed = tagged.withColumns({
        "cell_index": F.when(usable & F.col("inside_grid_domain"), cell),
        "price": F.when(usable, F.col("active_underlying_price_1545")),
        "_broken": usable & broken_inputs()})

    def weighed(name: str, output: str) -> Column:
        return F.sum(F.col(name) * vega).alias(output)

    return keyed.groupBy(*N.DAY, N.DECISION_TS, "cell_index", "price").agg(
        weighed("total_variance", "variance_vega"), weighed("implied_volatility_1545", "iv_vega"),
        weighed("spread_1545", "spread_vega"), F.sum(vega).alias("vega"),
        F.count(F.lit(1)).alias("n"), F.count_if("_broken").alias("n_broken"))


def summed_cells(sums: DataFrame, settings: SurfaceSettings) -> DataFrame:
    """``observed_cells`` from ``quote_sums``."""
    def mean(name: str) -> Column:
        return ratio(F.sum(name), F.sum("vega"))

    return sums.filter("cell_index is not null").groupBy(*N.DAY, N.DECISION_TS, "cell_index").agg(
        mean("variance_vega").alias("observed_total_variance"), mean("iv_vega").alias("observed_iv"),
        mean("spread_vega").alias("weighted_spread_1545"), F.sum("vega").alias("vega_sum"),
        F.sum("n").alias("observation_count"),
    ).withColumn("observed_mask",
                 F.col("observation_count") >= settings.observed_cell_min_count)


def summed_prices(sums: DataFrame) -> DataFrame:
    """(day, price, weight) of the usable quotes from ``quote_sums``."""
    return sums.filter("price is not null").groupBy(*N.DAY, "price").agg(F.sum("n").alias("weight"))


def surface_days(cells: DataFrame, grid: SurfaceGrid) -> DataFrame:
    """Densify: one row per day whose arrays cover every cell of the grid.

    Absent cells get mask false, count 0, vega 0, spread 0 and NULL values.
    """
    slot = F.struct("cell_index", F.struct(*CELL_ARRAYS).alias("cell"))
    days = cells.groupBy(*N.DAY, N.DECISION_TS).agg(
        F.map_from_entries(F.collect_list(slot)).alias("by_cell"),
    )
    slots = F.transform(F.sequence(F.lit(0), F.lit(grid.n_cells - 1)),
                        lambda i: F.try_element_at(F.col("by_cell"), i))
    fills = {"weighted_spread_1545": F.lit(0.0), "vega_sum": F.lit(0.0),
             "observation_count": F.lit(0).cast("long"), "observed_mask": F.lit(False)}

    def plane(name: str) -> Column:
        fill = fills.get(name)
        return F.transform("slots", lambda s: s[name] if fill is None
                           else F.coalesce(s[name], fill)).alias(name)

    return days.withColumn("slots", slots).select(
        *N.DAY, N.DECISION_TS, *[plane(name) for name in CELL_ARRAYS])


def observed_surface(assigned: DataFrame, settings: SurfaceSettings) -> DataFrame:
    """The dense observed surface in long form."""
    days = surface_days(observed_cells(assigned, settings), settings.grid)
    return dense_rows(days, settings.grid, CELL_ARRAYS, (*N.DAY, N.DECISION_TS))


def complete_surface(days: DataFrame, settings: SurfaceSettings,
                     order: tuple[str, ...] | None = None) -> DataFrame:
    """Add completed total variance, completed volatility and completion status arrays."""
    filled = complete(F.col("observed_total_variance"), F.col("observed_mask"), settings.grid,
                      order or settings.interpolation_order, settings.interpolation_cycles,
                      settings.total_variance_floor)
    grid = settings.grid
    iv = F.transform(
        "completed_total_variance",
        lambda w, i: total_variance_to_iv(
            w, F.element_at(doubles(grid.maturity_years),
                            F.floor(i / F.lit(grid.n_moneyness)).cast("int") + 1)))
    return (
        days.withColumn("_filled", filled)
        .withColumn("completed_total_variance", F.col("_filled.total_variance"))
        .withColumn("completion_status", status_names(F.col("_filled.status")))
        .withColumn("completed_iv", iv)
        .drop("_filled")
    )


def gold_days(assigned: DataFrame, settings: SurfaceSettings) -> DataFrame:
    """Completed surface per day with its identity columns: the gold stage table."""
    return gold_of_cells(observed_cells(assigned, settings), settings)


def gold_of_cells(cells: DataFrame, settings: SurfaceSettings) -> DataFrame:
    completed = complete_surface(surface_days(cells, settings.grid), settings)
    return settings.grid.with_ids(completed, settings.config_hash)


def dense_rows(days: DataFrame, grid: SurfaceGrid, arrays: tuple[str, ...],
               keep: tuple[str, ...]) -> DataFrame:
    """Open cell arrays into one row per cell; narrow, no shuffle."""
    zipped = F.arrays_zip(*[F.col(name) for name in arrays])
    opened = days.select(*keep, F.posexplode(zipped).alias("cell_index", "_cell"))
    flat = opened.select(*keep, "cell_index", *[F.col("_cell")[a].alias(a) for a in arrays])
    return grid.with_coordinates(flat)


def gold_rows(days: DataFrame, grid: SurfaceGrid) -> DataFrame:
    """The long gold layout: one row per day and cell with the identity columns."""
    return dense_rows(days, grid, COMPLETED_ARRAYS, (*N.DAY, N.DECISION_TS, *N.SURFACE_IDS))


def dense_arrays(rows: DataFrame, arrays: tuple[str, ...], keys: tuple[str, ...],
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """Long cells back to arrays ordered by cell_index, with constants of the key carried."""
    ordered = F.sort_array(F.collect_list(F.struct("cell_index", *arrays)))
    grouped = rows.groupBy(*keys).agg(
        *[F.max(name).alias(name) for name in carry], ordered.alias("_cells"))
    return grouped.select(*keys, *carry, *[F.col(f"_cells.{a}").alias(a) for a in arrays])


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, v: acc + v)


def liquidity_daily(days: DataFrame) -> DataFrame:
    """Coverage, option count, vega and vega-weighted spread per day; narrow."""
    spread = _total(F.zip_with("weighted_spread_1545", "vega_sum", lambda s, v: s * v))
    return days.select(
        *N.DAY,
        F.size(F.filter("observed_mask", lambda m: m)).cast("long").alias("observed_cell_count"),
        F.size("observed_mask").cast("long").alias("grid_cell_count"),
        _total(F.col("vega_sum")).alias("daily_vega_sum"),
        F.aggregate("observation_count", F.lit(0).cast("long"),
                    lambda acc, n: acc + n).alias("daily_option_count"),
        spread.alias("_spread"),
    ).select(
        *N.DAY, "observed_cell_count", "grid_cell_count", "daily_vega_sum",
        "daily_option_count",
        (F.col("observed_cell_count") / F.col("grid_cell_count")).alias("coverage_ratio"),
        F.when(F.col("daily_vega_sum") > 0.0,
               ratio(F.col("_spread"), F.col("daily_vega_sum")))
        .otherwise(0.0).alias("daily_weighted_spread_1545"),
    )


def surface_build_summary(assigned: DataFrame, settings: SurfaceSettings) -> DataFrame:
    """Build status and row counts of every day in the classified panel, in one aggregate.

    `assigned` is the whole flagged panel after cell assignment, valid or not. Observed
    cells are counted from per-cell partial counts, so no row list is ever held.
    """
    valid = F.col("is_valid_observation")
    inside = valid & F.col("inside_grid_domain")
    cell = F.when(inside, settings.grid.cell_index(F.col("maturity_index"),
                                                   F.col("moneyness_index")))
    per_cell = assigned.groupBy(*N.DAY, cell.alias("cell_index")).agg(
        F.count_if(valid).alias("valid"), F.count_if(inside).alias("inside"))
    is_observed = F.col("cell_index").isNotNull() & (
        F.col("inside") >= settings.observed_cell_min_count)
    counted = per_cell.groupBy(*N.DAY).agg(
        F.sum("valid").alias("valid_rows"),
        F.sum("inside").alias("rows_inside_grid_domain"),
        F.count_if(is_observed).alias("observed_cells"),
    )
    return counted.withColumn(
        "rows_outside_grid_domain", F.col("valid_rows") - F.col("rows_inside_grid_domain")
    ).withColumn(
        "status",
        F.when(F.col("valid_rows") == 0, "skipped_no_valid_rows")
        .when(F.col("rows_inside_grid_domain") == 0, "skipped_no_rows_inside_grid_domain")
        .otherwise("built"),
    )


def completion_sensitivity(days: DataFrame, settings: SurfaceSettings,
                           alternate_order: tuple[str, ...]) -> DataFrame:
    """Effect of the axis order: re-complete stored observations and compare; narrow."""
    filled = complete(F.col("observed_total_variance"), F.col("observed_mask"), settings.grid,
                      alternate_order, settings.interpolation_cycles,
                      settings.total_variance_floor)
    again = days.withColumn("_alt", filled["total_variance"])
    gap = F.zip_with("_alt", "completed_total_variance", lambda a, b: F.abs(a - b))
    n = F.lit(float(settings.grid.n_cells))
    return again.withColumn("_gap", gap).select(
        *N.DAY,
        F.size(F.filter("observed_mask", lambda m: m)).cast("long").alias("observed_cell_count"),
        F.size("observed_mask").cast("long").alias("total_cell_count"),
        (_total(F.col("_gap")) / n).alias("mean_abs_diff"),
        F.sqrt(_total(F.transform("_gap", lambda g: g * g)) / n).alias("rmse_diff"),
        F.array_max("_gap").alias("max_abs_diff"),
    )


def sensitivity_summary(daily: DataFrame, keys: tuple[str, ...] = (N.SYMBOL,)) -> DataFrame:
    return daily.groupBy(*keys).agg(
        F.avg("mean_abs_diff").alias("mean_mean_abs_diff"),
        F.avg("rmse_diff").alias("mean_rmse_diff"),
        F.max("max_abs_diff").alias("max_max_abs_diff"),
        F.count(F.lit(1)).alias("n_quote_dates"),
    )
