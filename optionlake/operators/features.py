"""Leak-free lagged features and next-session targets.

Windows run per underlying and cell, so a window group is bounded by the number of sessions
however many quotes an underlying has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions.grid import SurfaceGrid
from optionlake.operators.calendar import add_gap_sessions
from optionlake.operators.surface import dense_arrays, dense_rows, liquidity_daily

TARGET_ARRAYS = ("target_total_variance", "target_observed_mask", "target_vega_weight",
                 "target_training_weight")
LIQUIDITY_FEATURES = ("coverage_ratio", "daily_option_count", "daily_vega_sum",
                      "daily_weighted_spread_1545")


@dataclass(frozen=True)
class FeatureSettings:
    lag_windows: tuple[int, ...] = (1, 5, 22)
    include_daily_change: bool = True
    include_mask: bool = True
    include_liquidity: bool = True

    @property
    def first_row(self) -> int:
        """1-based position of the first day with a full history."""
        return max(max(self.lag_windows), 2 if self.include_daily_change else 1)

    @property
    def surface_blocks(self) -> tuple[str, ...]:
        return tuple(f"feature_surface_mean_{w:02d}" for w in self.lag_windows)

    @property
    def feature_arrays(self) -> tuple[str, ...]:
        """Array features in model order: surface means, change, mask means."""
        change = ("feature_surface_change_01",) if self.include_daily_change else ()
        masks = tuple(f"feature_mask_mean_{w:02d}" for w in self.lag_windows)
        return self.surface_blocks + change + (masks if self.include_mask else ())

    @property
    def scalars(self) -> tuple[str, ...]:
        return tuple(f"feature_{s}" for s in LIQUIDITY_FEATURES) if self.include_liquidity else ()


def training_weight(mask: Column, vega: Column) -> Column:
    """Vega on observed cells (which must be positive), one on completed cells."""
    def fail(text: str) -> Column:
        return F.raise_error(text).cast("double")

    return (
        F.when(mask.isNull() | ~mask.isin(0.0, 1.0), fail("target mask must be 0 or 1"))
        .when(vega.isNull() | F.isnan(vega) | (vega < 0.0) | (vega == float("inf")),
              fail("target vega must be finite and non-negative"))
        .when((mask == 1.0) & (vega <= 0.0), fail("observed target cells need positive vega"))
        .when(mask == 1.0, vega)
        .otherwise(1.0)
    )


def feature_cells(gold_days: DataFrame, grid: SurfaceGrid,
                  settings: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Long features: lag means, one-day change and next-date targets per cell.

    Lags count observed dates. Days without a full history or without a next date drop out.
    """
    rows = dense_rows(gold_days, grid,
                      ("completed_total_variance", "observed_mask", "vega_sum"),
                      (*N.DAY, N.DECISION_TS))
    w, mask = F.col("completed_total_variance"), F.col("observed_mask").cast("double")
    line = Window.partitionBy(N.SYMBOL, "cell_index").orderBy(N.DATE)

    def lag_mean(value: Column, days: int) -> Column:
        return value if days == 1 else F.avg(value).over(line.rowsBetween(1 - days, 0))

    columns: dict[str, Column] = {}
    for days, name in zip(settings.lag_windows, settings.surface_blocks):
        columns[name] = lag_mean(w, days)
        if settings.include_mask:
            columns[f"feature_mask_mean_{days:02d}"] = lag_mean(mask, days)
    if settings.include_daily_change:
        columns["feature_surface_change_01"] = w - F.lag(w).over(line)
    columns |= {
        "_row": F.row_number().over(line),
        N.TARGET_DATE: F.lead(N.DATE).over(line),
        N.TARGET_TS: F.lead(N.DECISION_TS).over(line),
        "target_total_variance": F.lead(w).over(line),
        "target_observed_mask": F.lead(mask).over(line),
        "target_vega_weight": F.lead("vega_sum").over(line),
    }
    built = rows.select(*N.DAY, "cell_index", N.DECISION_TS,
                        *[c.alias(name) for name, c in columns.items()])
    usable = built.filter((F.col("_row") >= settings.first_row)
                          & F.col(N.TARGET_DATE).isNotNull())
    return usable.withColumn(
        "target_training_weight",
        training_weight(F.col("target_observed_mask"), F.col("target_vega_weight")),
    ).drop("_row")


def build_features(gold_days: DataFrame, grid: SurfaceGrid, lookup: DataFrame,
                   settings: FeatureSettings = FeatureSettings()) -> DataFrame:
    """One model-ready row per underlying and day, vectors as arrays in cell order."""
    cells = feature_cells(gold_days, grid, settings)
    days = dense_arrays(cells, (*settings.feature_arrays, *TARGET_ARRAYS),
                        (*N.DAY, N.TARGET_DATE), (N.DECISION_TS, N.TARGET_TS))
    days = add_gap_sessions(days, lookup)
    identities = gold_days.select(*N.DAY, *N.SURFACE_IDS)
    if settings.include_liquidity:
        liquid = liquidity_daily(gold_days.select("*")).select(
            *N.DAY, *[F.col(s).alias(f"feature_{s}") for s in LIQUIDITY_FEATURES])
        days = days.join(liquid, list(N.DAY), "inner")
    return days.join(identities, list(N.DAY), "inner")


def feature_lineage(gold_days: DataFrame, known_at: str = N.DECISION_TS,
                    settings: FeatureSettings = FeatureSettings()) -> DataFrame:
    """(underlying, date, ``newest``): per feature, the newest instant of all surfaces in its window.

    ``known_at`` names the instant at which a day's surface was known, later than its decision if
    it was revised. Surfaces are dense, so windows over days are those of every cell: one row a day.
    """
    line = Window.partitionBy(N.SYMBOL).orderBy(N.DATE)
    reach = {name: days for days, name in zip(settings.lag_windows, settings.surface_blocks)}
    if settings.include_daily_change:
        reach["feature_surface_change_01"] = 2
    if settings.include_mask:
        reach |= {f"feature_mask_mean_{days:02d}": days for days in settings.lag_windows}
    reach |= dict.fromkeys(settings.scalars, 1)
    known = F.to_timestamp(known_at)
    newest = [F.max(known).over(line.rowsBetween(1 - days, 0)).alias(name)
              for name, days in reach.items()]
    return gold_days.select(*N.DAY, known_at).distinct().select(*N.DAY, F.struct(*newest).alias("newest"))


def feature_vector(settings: FeatureSettings = FeatureSettings()) -> Column:
    """All features of a day as one array in model order."""
    scalars = [F.array(*[F.col(s).cast("double") for s in settings.scalars])] \
        if settings.scalars else []
    return F.concat(*[F.col(a) for a in settings.feature_arrays], *scalars)


def widen_features(days: DataFrame, grid: SurfaceGrid,
                   settings: FeatureSettings = FeatureSettings()) -> DataFrame:
    """The flat layout: one column per cell with a four-digit cell suffix."""
    def block(name: str) -> list[Column]:
        return [F.element_at(name, i + 1).alias(f"{name}_{i:04d}") for i in range(grid.n_cells)]

    flat = [c for name in settings.feature_arrays for c in block(name)]
    targets = [c for name in TARGET_ARRAYS for c in block(name)]
    return days.select(*N.DAY, N.TARGET_DATE, N.DECISION_TS, N.TARGET_TS, "target_gap_sessions",
                       *N.SURFACE_IDS, *flat, *settings.scalars, *targets)


def check_feature_layout(columns: list[str], grid: SurfaceGrid,
                         lags: tuple[int, ...] = (1, 5, 22)) -> None:
    """The widened table must start its features with whole lag blocks in grid order."""
    features = [c for c in columns if c.startswith("feature_")]
    expected = [f"feature_surface_mean_{w:02d}_{i:04d}" for w in lags
                for i in range(grid.n_cells)]
    if features[:len(expected)] != expected:
        raise ValueError(f"features must start with the lag blocks {lags} in grid order")


def role_of_column(name: str) -> tuple[str, str]:
    """(role, column holding the instant at which it is known) of a feature-table column."""
    known, later = N.DECISION_TS, N.TARGET_TS
    exact = {
        N.SYMBOL: ("alignment_key", known), N.DATE: ("alignment_key", known),
        N.TARGET_DATE: ("target_alignment", later),
        "target_gap_sessions": ("target_alignment", later),
        N.DECISION_TS: ("decision_timestamp", known), N.TARGET_TS: ("decision_timestamp", later),
        **{name: ("surface_metadata", known) for name in N.SURFACE_IDS},
    }
    if name in exact:
        return exact[name]
    prefixes = (("feature_", ("model_feature", known)),
                ("target_total_variance", ("target", later)),
                ("target_observed_mask", ("target", later)),
                ("target_vega_weight", ("target_weight", later)),
                ("target_training_weight", ("target_weight", later)))
    for prefix, role in prefixes:
        if name.startswith(prefix):
            return role
    raise ValueError(f"column {name!r} has no declared availability")


def column_roles(df: DataFrame) -> DataFrame:
    rows = [(name, *role_of_column(name)) for name in df.columns]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, role string, availability_reference_column string")


def weighted_surface_mse(days: DataFrame, predicted: str, observed_weight: float,
                         imputed_weight: float, keys: tuple[str, ...]) -> DataFrame:
    """Completed-surface MSE with separate observed and imputed weights, per key."""
    for weight in (observed_weight, imputed_weight):
        if not (0.0 <= weight < float("inf")):
            raise ValueError("loss weights must be finite and non-negative")
    zipped = F.arrays_zip(F.col(predicted).alias("p"), F.col("target_total_variance").alias("y"),
                          F.col("target_observed_mask").alias("m"),
                          F.col("target_training_weight").alias("t"))
    cells = days.select(*keys, F.explode(zipped).alias("c")).select(*keys, "c.*")
    weight = F.when(F.col("m") == 1.0, F.lit(float(observed_weight))) \
        .otherwise(F.lit(float(imputed_weight))) * F.col("t")
    error = F.col("p") - F.col("y")
    return cells.groupBy(*keys).agg(
        F.try_divide(F.sum(error * error * weight), F.sum(weight)).alias("weighted_surface_mse"),
        F.sum(weight).alias("weight_sum"))
