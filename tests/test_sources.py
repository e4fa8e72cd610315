import datetime as dt
import pathlib
import zipfile

import pytest
from pyspark.sql import functions as F

from optionlake.operators.contracts import ContractError, check_header
from optionlake.sources import quotes as qs
from optionlake.sources import tables
from optionlake.streaming import jobs

START, END = dt.date(2021, 1, 1), dt.date(2021, 12, 31)


def quote_line(day, symbol, strike, option_type="C", open_interest="10", iv=0.2):
    values = {c: "1" for c in qs.RAW_COLUMNS}
    values |= {"underlying_symbol": symbol, "quote_date": day, "root": "SPXW",
               "expiration": "2021-03-19", "strike": str(strike), "option_type": option_type,
               "open_interest": open_interest, "implied_volatility_1545": str(iv)}
    return ",".join(values[c] for c in qs.RAW_COLUMNS)


def write_zip(folder, day, lines, header=None, members=1):
    path = pathlib.Path(folder) / f"UnderlyingOptionsEODCalcs_{day}.zip"
    text = "\n".join([header or ",".join(qs.RAW_COLUMNS), *lines]) + "\n"
    with zipfile.ZipFile(path, "w") as archive:
        for i in range(members):
            archive.writestr(f"quotes_{day}_{i}.csv", text)
    return path


def day_lines(day, n=3):
    return [quote_line(day, "^SPX", 100 + i) for i in range(n)] + [quote_line(day, "AAPL", 50)]


def test_zips_become_typed_rows_and_empty_open_interest_is_null(spark, folder):
    write_zip(folder, "2021-01-04", [quote_line("2021-01-04", "^SPX", 100.5, open_interest="")])
    row = qs.read_quote_zips(spark, folder).collect()[0]
    assert row.quote_date == dt.date(2021, 1, 4) and row.strike == 100.5
    assert row.open_interest is None and row.source_zip.endswith("2021-01-04.zip")


def test_extra_allowed_columns_are_projected_away(spark, folder):
    header = ",".join([*qs.RAW_COLUMNS, "vwap"])
    write_zip(folder, "2021-01-04", [quote_line("2021-01-04", "^SPX", 100) + ",9"], header)
    assert qs.read_quote_zips(spark, folder).columns == [*qs.RAW_COLUMNS, "source_zip"]
    assert qs.read_quote_zips(spark, folder).count() == 1


@pytest.mark.parametrize("header", [",".join(qs.RAW_COLUMNS[1:]),
                                    ",".join([*qs.RAW_COLUMNS, "surprise"])])
def test_header_drift_fails(spark, folder, header):
    write_zip(folder, "2021-01-04", [quote_line("2021-01-04", "^SPX", 100)], header)
    with pytest.raises(Exception, match="schema drift"):
        qs.read_quote_zips(spark, folder).collect()


def test_two_members_fail(spark, folder):
    write_zip(folder, "2021-01-04", day_lines("2021-01-04"), members=2)
    with pytest.raises(Exception, match="exactly one CSV"):
        qs.read_quote_zips(spark, folder).collect()


def test_bad_dates_fail(spark, folder):
    write_zip(folder, "2021-01-04", [quote_line("2021-13-04", "^SPX", 100)])
    with pytest.raises(Exception):
        qs.read_quote_zips(spark, folder).collect()


def test_plain_csv_reads_like_the_zip(spark, folder):
    lines = day_lines("2021-01-04")
    path = pathlib.Path(folder) / "quotes.csv"
    path.write_text("\n".join([",".join(qs.RAW_COLUMNS), *lines]) + "\n")
    rows = qs.read_quote_csv(spark, str(path))
    assert rows.count() == 4 and rows.columns == [*qs.RAW_COLUMNS, "source_zip"]
    (pathlib.Path(folder) / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception):
        qs.read_quote_csv(spark, str(pathlib.Path(folder) / "bad.csv")).collect()
    heads = qs.csv_headers(spark, str(path)).collect()
    assert [h.value for h in heads] == [",".join(qs.RAW_COLUMNS)]


def test_check_header_names_the_columns():
    check_header(list(qs.RAW_COLUMNS), qs.RAW_COLUMNS, qs.ALLOWED_EXTRA_COLUMNS)
    with pytest.raises(ContractError, match="surprise"):
        check_header([*qs.RAW_COLUMNS, "surprise"], qs.RAW_COLUMNS, qs.ALLOWED_EXTRA_COLUMNS)


def test_ingest_summary_counts_and_statuses(spark, folder):
    write_zip(folder, "2021-01-04", day_lines("2021-01-04"))
    write_zip(folder, "2020-01-06", day_lines("2020-01-06", 2))
    write_zip(folder, "2021-01-05", [quote_line("2021-01-05", "AAPL", 1)])
    write_zip(folder, "2021-01-06", [quote_line("2021-01-06", "^SPX", 1),
                                     quote_line("2021-01-07", "^SPX", 1)])
    summary = qs.ingest_summary(qs.read_quote_zips(spark, folder), ("^SPX",), START, END)
    found = {r.source_zip[-14:-4]: (r.status, r.raw_row_count, r.target_symbol_row_count)
             for r in summary.collect()}
    assert found == {
        "2021-01-04": ("written", 4, 3),
        "2020-01-06": ("skipped_out_of_sample_window", 3, 2),
        "2021-01-05": ("error_no_target_rows", 1, 0),
        "2021-01-06": ("error_several_quote_dates", 2, 2)}
    totals = {r.status: r.raw_rows for r in qs.ingest_totals(summary).collect()}
    assert totals["written"] == 4


def test_partition_write_replaces_only_its_days(spark, folder):
    path = f"{folder}/bronze"
    rows = spark.createDataFrame(
        [(dt.date(2021, 1, 4), 1.0), (dt.date(2021, 1, 5), 2.0)], "quote_date date, x double")
    tables.write_day_partitions(rows, path)
    tables.write_day_partitions(rows.filter("x = 2").withColumn("x", F.lit(5.0)), path)
    back = {r.quote_date: r.x for r in tables.read_panel(spark, path).collect()}
    assert back == {dt.date(2021, 1, 4): 1.0, dt.date(2021, 1, 5): 5.0}


def test_report_tables_show_six_decimals(spark, folder):
    df = spark.createDataFrame([("b", 0.12345678, True, [1]), ("a", float("nan"), None, None)],
                               "name string, x double, ok boolean, items array<int>")
    tables.write_report_table(df, folder, ("name",))
    shown = [tuple(r) for r in spark.read.csv(f"{folder}/csv", header=True).collect()]
    assert shown == [("a", "nan", None, None), ("b", "0.123457", "true", "[1]")]


def test_load_test_records(spark, folder):
    df = spark.createDataFrame([("A", "mse", 0.1), ("A", "mse", 0.2), ("A", "qlike", 0.3)],
                               "underlying_symbol string, loss_metric string, p_value double")
    df.write.parquet(f"{folder}/tests")
    assert tables.load_test_records(spark, f"{folder}/tests", "mse").count() == 2
    assert tables.load_test_records(spark, f"{folder}/tests", "qlike", True).count() == 1
    with pytest.raises(ValueError, match="several"):
        tables.load_test_records(spark, f"{folder}/tests", "mse", True)
    with pytest.raises(ValueError, match="no test results"):
        tables.load_test_records(spark, f"{folder}/tests", "mae")


def test_stream_ingest_skips_done_files_and_is_idempotent(spark, folder):
    raw, bronze, mark = (f"{folder}/{n}" for n in ("raw", "bronze", "mark"))
    pathlib.Path(raw).mkdir()

    def run():
        query = jobs.stream_ingest(spark, raw, bronze, mark, ("^SPX",), START, END)
        query.awaitTermination()
        return query

    write_zip(raw, "2021-01-04", day_lines("2021-01-04"))
    write_zip(raw, "2021-01-05", day_lines("2021-01-05", 2))
    run()
    assert tables.read_panel(spark, bronze).count() == 5
    run()
    assert tables.read_panel(spark, bronze).count() == 5
    write_zip(raw, "2021-01-06", day_lines("2021-01-06", 1))
    run()
    counts = {str(r.quote_date): r["count"] for r in
              tables.read_panel(spark, bronze).groupBy("quote_date").count().collect()}
    assert counts == {"2021-01-04": 3, "2021-01-05": 2, "2021-01-06": 1}
