"""Cases that once lost data in silence: they now raise, or keep every row."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from optionlake.operators import calendar as cal
from optionlake.operators import compare
from optionlake.sources.tables import read_panel, write_day_partitions
from optionlake.streaming.jobs import INGEST_PARTS

DAY = dt.date(2024, 6, 3)


def lookup(spark, end):
    start = dt.date(2024, 1, 1)
    sessions = cal.session_table(cal.exchange_sessions(spark, start, end))
    return cal.session_lookup(sessions, start, end)


def quotes(spark):
    return spark.createDataFrame([("SPXW", DAY, dt.date(2025, 6, 20))],
                                 "root string, quote_date date, expiration date")


def test_expiration_past_the_calendar_raises(spark):
    with pytest.raises(Exception, match="no session for expiration"):
        cal.add_tau_years(quotes(spark), lookup(spark, dt.date(2024, 12, 31))).collect()


def test_expiration_inside_a_longer_calendar(spark):
    row = cal.add_tau_years(quotes(spark), lookup(spark, dt.date(2025, 12, 31))).first()
    assert row.tau_years > 1


def test_two_files_of_one_day_survive(spark, folder):
    for file, symbol, n in (("a", "AAA", 2), ("b", "BBB", 3), ("b", "BBB", 3)):
        rows = [(DAY, file, symbol, float(i)) for i in range(n)]
        write_day_partitions(spark.createDataFrame(
            rows, "quote_date date, source_zip string, underlying_symbol string, bid double"),
            folder, INGEST_PARTS)
    stored = read_panel(spark, folder).groupBy("source_zip").count().collect()
    assert {r.source_zip: r["count"] for r in stored} == {"a": 2, "b": 3}


def losses(spark, second_day, value=1.0):
    days = [DAY, DAY + dt.timedelta(days=1)]
    rows = [("S", "m", "x", d, 1.0) for d in days] + [("S", "m", "y", DAY, 1.0),
                                                      ("S", "m", "y", second_day, value)]
    return spark.createDataFrame(
        rows, "underlying_symbol string, metric_name string, model_name string, target_date date, "
              "loss double").withColumnRenamed("metric_name", compare.SERIES[1])


def test_series_of_different_dates_are_refused(spark):
    late = losses(spark, DAY + dt.timedelta(days=9))
    with pytest.raises(Exception, match="differ in dates"):
        compare.loss_series(late).collect()
    with pytest.raises(Exception, match="no benchmark"):
        compare.diebold_mariano(late, "x").collect()


def test_non_finite_losses_are_refused(spark):
    bad = losses(spark, DAY + dt.timedelta(days=1), float("nan"))
    with pytest.raises(Exception, match="non-finite"):
        compare.loss_series(bad).collect()
    assert compare.loss_series(losses(spark, DAY + dt.timedelta(days=1))).select(
        F.col("n_obs")).first().n_obs == 2
