"""The fixed maturity x log-moneyness grid and its column expressions.

A grid has at most a few hundred cells, so its coordinates travel as literals inside
expressions; no operator joins a coordinate table to the data.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions.sqlmath import doubles

DAYS_PER_YEAR = 365.0


@dataclass(frozen=True)
class SurfaceGrid:
    maturity_days: tuple[int, ...]
    moneyness_points: tuple[float, ...]

    def __post_init__(self) -> None:
        for label, axis in (("maturity_days", self.maturity_days),
                            ("moneyness_points", self.moneyness_points)):
            if not axis:
                raise ValueError(f"{label} must not be empty")
            if not all(math.isfinite(v) for v in axis):
                raise ValueError(f"{label} must be finite")
            if any(b <= a for a, b in zip(axis, axis[1:])):
                raise ValueError(f"{label} must be strictly increasing")
        if self.maturity_days[0] <= 0:
            raise ValueError("maturity_days must be positive")

    @property
    def n_maturities(self) -> int:
        return len(self.maturity_days)

    @property
    def n_moneyness(self) -> int:
        return len(self.moneyness_points)

    @property
    def n_cells(self) -> int:
        return self.n_maturities * self.n_moneyness

    @property
    def maturity_years(self) -> tuple[float, ...]:
        return tuple(d / DAYS_PER_YEAR for d in self.maturity_days)

    @property
    def maturity_edges(self) -> tuple[float, ...]:
        years = self.maturity_years
        return tuple((a + b) / 2.0 for a, b in zip(years, years[1:]))

    @property
    def moneyness_edges(self) -> tuple[float, ...]:
        points = self.moneyness_points
        return tuple((a + b) / 2.0 for a, b in zip(points, points[1:]))

    @property
    def grid_hash(self) -> str:
        identity = {
            "surface_grid_schema_version": N.GRID_SCHEMA_VERSION,
            "maturity_coordinate": N.MATURITY_COORDINATE,
            "moneyness_coordinate": N.MONEYNESS_COORDINATE,
            "maturity_days": list(self.maturity_days),
            "moneyness_points": list(self.moneyness_points),
        }
        text = json.dumps(identity, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    def cell_index(self, maturity_index: Column, moneyness_index: Column) -> Column:
        return (maturity_index * self.n_moneyness + moneyness_index).cast("int")

    def maturity_index_of(self, cell_index: Column) -> Column:
        return F.floor(cell_index / F.lit(self.n_moneyness)).cast("long")

    def moneyness_index_of(self, cell_index: Column) -> Column:
        return (cell_index % F.lit(self.n_moneyness)).cast("long")

    def maturity_days_at(self, index: Column) -> Column:
        days = F.array(*[F.lit(int(d)).cast("long") for d in self.maturity_days])
        return F.element_at(days, index.cast("int") + 1)

    def moneyness_at(self, index: Column) -> Column:
        return F.element_at(doubles(self.moneyness_points), index.cast("int") + 1)

    def tau_at(self, index: Column) -> Column:
        return F.element_at(doubles(self.maturity_years), index.cast("int") + 1)

    def with_coordinates(self, df: DataFrame) -> DataFrame:
        """Derive the four coordinate columns from cell_index."""
        return df.withColumns({
            "maturity_index": self.maturity_index_of(F.col("cell_index")),
            "moneyness_index": self.moneyness_index_of(F.col("cell_index")),
        }).withColumns({
            "maturity_days": self.maturity_days_at(F.col("maturity_index")),
            "moneyness_point": self.moneyness_at(F.col("moneyness_index")),
        })

    def with_ids(self, df: DataFrame, surface_config_hash: str) -> DataFrame:
        return df.withColumns({
            "surface_grid_schema_version": F.lit(N.GRID_SCHEMA_VERSION),
            "surface_grid_hash": F.lit(self.grid_hash),
            "maturity_coordinate": F.lit(N.MATURITY_COORDINATE),
            "moneyness_coordinate": F.lit(N.MONEYNESS_COORDINATE),
            "target_surface_version": F.lit(N.SURFACE_VERSION),
            "surface_config_hash": F.lit(surface_config_hash),
        })

    def cells(self, spark: SparkSession) -> DataFrame:
        """One row per cell; used only where a check has to name absent cells."""
        return self.with_coordinates(
            spark.range(self.n_cells).select(F.col("id").cast("int").alias("cell_index"))
        )


@dataclass(frozen=True)
class SurfaceSettings:
    """Grid plus the rules that turn quotes into one surface per day."""

    grid: SurfaceGrid
    interpolation_order: tuple[str, ...] = ("maturity", "moneyness")
    interpolation_cycles: int = 2
    total_variance_floor: float = 1.0e-8
    observed_cell_min_count: int = 1

    def __post_init__(self) -> None:
        if sorted(self.interpolation_order) != ["maturity", "moneyness"]:
            raise ValueError("interpolation_order must name maturity and moneyness once each")
        if self.interpolation_cycles < 1:
            raise ValueError("interpolation_cycles must be positive")
        if self.observed_cell_min_count < 1:
            raise ValueError("observed_cell_min_count must be positive")
        if not self.total_variance_floor > 0.0:
            raise ValueError("total_variance_floor must be positive")

    @property
    def config_hash(self) -> str:
        text = json.dumps({
            "grid": self.grid.grid_hash,
            "interpolation_order": list(self.interpolation_order),
            "interpolation_cycles": self.interpolation_cycles,
            "total_variance_floor": self.total_variance_floor,
            "observed_cell_min_count": self.observed_cell_min_count,
        }, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode("utf-8")).hexdigest()
