"""One underlying and day with a third of all quotes gives whole, exact results."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from optionlake import names as N
from optionlake.functions.grid import SurfaceGrid, SurfaceSettings
from optionlake.operators import panel, surface
from optionlake.sources import tables

GRID = SurfaceGrid((30, 90, 180), (-0.1, 0.0, 0.1))
ROWS = 150_000


def quotes(spark):
    hot = F.col("id") % 3 == 0
    i = F.col("id")
    return spark.range(ROWS).select(
        F.when(hot, "HOT").otherwise(F.concat(F.lit("S"), i % 7)).alias(N.SYMBOL),
        F.date_add(F.lit(dt.date(2021, 1, 4)), F.when(hot, 0).otherwise((i % 11).cast("int")))
        .alias(N.DATE),
        F.lit("t").alias(N.DECISION_TS), F.lit(True).alias("is_valid_observation"),
        (F.lit(30.0) + (i * 7) % 151).alias("_days"),
        (((i * 13) % 201) / 1000.0 - 0.1).alias("log_moneyness"),
        (F.lit(0.15) + (i % 17) / 100.0).alias("implied_volatility_1545"),
        ((i % 5) + 1).cast("double").alias("vega_1545"), F.lit(0.1).alias("spread_1545"),
        (F.lit(100.0) + i % 3).alias("active_underlying_price_1545"),
    ).withColumn("tau_years", F.col("_days") / 365.0).withColumn(
        "total_variance", F.col("implied_volatility_1545") ** 2 * F.col("tau_years"))


def test_hot_day_surface_and_spot(spark):
    rows = quotes(spark)
    days = surface.gold_days(panel.assign_grid_cell(rows, GRID), SurfaceSettings(GRID))
    hot = days.filter("underlying_symbol = 'HOT'").collect()
    assert len(hot) == 1 and sum(hot[0].observation_count) == ROWS // 3
    i = np.arange(0, ROWS, 3)
    tau = (30.0 + (i * 7) % 151) / 365.0
    m = ((i * 13) % 201) / 1000.0 - 0.1
    cell = np.searchsorted(GRID.maturity_edges, tau, side="right") * 3 + np.searchsorted(
        GRID.moneyness_edges, m, side="right")
    w, vega = (0.15 + (i % 17) / 100.0) ** 2 * tau, (i % 5) + 1.0
    expected = [np.average(w[cell == c], weights=vega[cell == c]) for c in range(9)]
    assert hot[0].observed_total_variance == pytest.approx(expected)
    spot = {r[N.SYMBOL]: r for r in panel.spot_daily(rows).collect()}["HOT"]
    assert spot.spot_row_count == ROWS // 3 and spot.spot == 100.0


def test_hot_day_is_written_by_several_tasks(spark, folder):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "256k")
    try:
        tables.write_day_partitions(quotes(spark), folder)
    finally:
        spark.conf.set(size, before)
    back = tables.read_panel(spark, folder)
    assert back.count() == ROWS
    files = back.filter("underlying_symbol = 'HOT'").select(
        F.input_file_name().alias("f")).distinct().count()
    assert files > 1
