"""Option quotes as a deterministic view of lineitem, plus the settings the checks use."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optionlake.functions.grid import SurfaceGrid, SurfaceSettings
from optionlake.operators import calendar as cal
from optionlake.operators import panel as pn

GRID = SurfaceGrid(maturity_days=(7, 30, 91, 364), moneyness_points=(-0.3, -0.1, 0.0, 0.1, 0.3))
SETTINGS = SurfaceSettings(GRID)
RULES = pn.CleaningRules(max_abs_log_moneyness=0.35, max_tau_years=1.05)
CALENDAR_START, CALENDAR_END = dt.date(1994, 12, 1), dt.date(2003, 3, 31)
DAY_ZERO = dt.date(1995, 1, 1)


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze-shaped quotes of every row, with the calendar-free maturity days / 365.

    Rows shipped on a weekend quote on the Friday before.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    shipped = F.datediff(F.col("l_shipdate").cast("date"), F.lit(DAY_ZERO))
    day = shipped - F.greatest((shipped + 6) % 7 - 4, F.lit(0))
    quantity, discount = F.col("l_quantity"), F.col("l_discount")
    base = items.select(
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        day.alias("dn"), F.date_add(F.lit(DAY_ZERO), day).alias("quote_date"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 401).cast("int").alias("exp_days"),
        "l_suppkey", "l_linenumber", quantity, discount, "l_tax",
    )
    cents = F.col("cents")
    m = (cents % 801) / F.lit(1000.0) - 0.3995
    spot = (F.lit(1000) + (F.col("dn") * 37) % 41).cast("double")
    return base.select(
        F.when(F.col("l_suppkey") % 5 == 0, "BBB").otherwise("AAA").alias("underlying_symbol"),
        "quote_date",
        F.when(F.col("l_linenumber") % 3 == 0, "SPX").otherwise("SPXW").alias("root"),
        F.date_add("quote_date", F.col("exp_days")).alias("expiration"),
        (spot * F.exp(m)).alias("strike"),
        F.when(cents % 223 == 0, F.lit(None).cast("string"))
        .when(cents % 211 == 0, "X").when(cents % 2 == 0, "C").otherwise("P")
        .alias("option_type"),
        quantity.cast("long").alias("trade_volume"),
        F.when(cents % 97 == 0, F.lit(None).cast("double")).when(quantity == 1, 0.0)
        .otherwise(quantity / 10.0).alias("bid_1545"),
        F.when(cents % 101 == 0, F.lit(float("nan"))).when(quantity == 50, 4.0)
        .otherwise(quantity / 10.0 + 0.05 + discount).alias("ask_1545"),
        spot.alias("active_underlying_price_1545"),
        F.when(cents % 89 == 0, 0.0)
        .otherwise(F.lit(0.15) + discount + 0.5 * m * m + F.col("l_tax") / 4.0)
        .alias("implied_volatility_1545"),
        F.when(cents % 83 == 0, 0.0).otherwise(quantity * (F.lit(1.0) - discount))
        .alias("vega_1545"),
        F.concat(F.lit("UnderlyingOptionsEODCalcs_"), F.col("quote_date").cast("string"),
                 F.lit(".zip")).alias("source_zip"),
        (F.col("exp_days") / F.lit(365.0)).alias("tau_years"),
    )


def weekday_lookup(spark: SparkSession) -> DataFrame:
    """The view trades every weekday, so its sessions are a user-supplied table."""
    sessions = cal.weekday_sessions(spark, CALENDAR_START, CALENDAR_END)
    return cal.session_lookup(cal.session_table(sessions), CALENDAR_START, CALENDAR_END)


def exchange_lookup(spark: SparkSession) -> DataFrame:
    sessions = cal.exchange_sessions(spark, CALENDAR_START, CALENDAR_END)
    return cal.session_lookup(cal.session_table(sessions), CALENDAR_START, CALENDAR_END)
