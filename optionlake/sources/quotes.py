"""Daily option-quote files: zipped CSV, plain CSV, and the bronze table made from them."""

from __future__ import annotations

import csv
import datetime as dt
import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optionlake import names as N

_TEXT = ("underlying_symbol", "quote_date", "root", "expiration", "option_type")
_WHOLE = ("trade_volume", "bid_size_1545", "ask_size_1545", "open_interest")

# The columns every quote file must have, and those it may also have.
RAW_COLUMNS = (
    "underlying_symbol", "quote_date", "root", "expiration", "strike", "option_type",
    "trade_volume", "bid_size_1545", "bid_1545", "ask_size_1545", "ask_1545",
    "underlying_bid_1545", "underlying_ask_1545", "active_underlying_price_1545",
    "implied_volatility_1545", "delta_1545", "gamma_1545", "theta_1545", "vega_1545",
    "rho_1545", "open_interest",
)
ALLOWED_EXTRA_COLUMNS = (
    "implied_underlying_price_1545", "open", "high", "low", "close", "bid_size_eod", "bid_eod",
    "ask_size_eod", "ask_eod", "underlying_bid_eod", "underlying_ask_eod", "vwap",
    "delivery_code",
)
RAW_GLOB = "UnderlyingOptionsEODCalcs_*.zip"
KEY_COLUMNS = (N.DATE, "expiration", "root", "strike", "option_type")


def _raw_type(name: str) -> T.DataType:
    if name in _TEXT:
        return T.StringType()
    return T.LongType() if name in _WHOLE else T.DoubleType()


RAW_SCHEMA = T.StructType([T.StructField(c, _raw_type(c)) for c in RAW_COLUMNS])
_ZIP_SCHEMA = T.StructType([*RAW_SCHEMA.fields, T.StructField("source_zip", T.StringType())])
_ARROW = {c: pa.string() if c in _TEXT else pa.int64() if c in _WHOLE else pa.float64()
          for c in RAW_COLUMNS}


def header_problems(columns: list[str]) -> str | None:
    missing = [c for c in RAW_COLUMNS if c not in columns]
    unknown = [c for c in columns if c not in RAW_COLUMNS and c not in ALLOWED_EXTRA_COLUMNS]
    if missing or unknown:
        return f"schema drift: missing={missing} unexpected={unknown}"
    return None


def _open_member(path: str, content: bytes) -> tuple[zipfile.ZipFile, str]:
    archive = zipfile.ZipFile(io.BytesIO(content))
    members = archive.namelist()
    if len(members) != 1:
        raise ValueError(f"{path} must hold exactly one CSV, found {len(members)}")
    return archive, members[0]


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream each file's single CSV out of its zip in Arrow blocks."""
    options = pacsv.ConvertOptions(column_types=_ARROW, include_columns=list(RAW_COLUMNS),
                                   null_values=[""], strings_can_be_null=True)
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"]):
            archive, member = _open_member(path, content.as_buffer().to_pybytes())
            with archive.open(member) as stream:
                header = next(csv.reader([stream.readline().decode("utf-8-sig")]))
            problem = header_problems(header)
            if problem:
                raise ValueError(f"{path}: {problem}")
            with archive.open(member) as stream:
                for block in pacsv.open_csv(stream, convert_options=options):
                    name = pa.array([path] * block.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [*(block.column(c) for c in RAW_COLUMNS), name],
                        names=[*RAW_COLUMNS, "source_zip"])


def _typed_dates(df: DataFrame) -> DataFrame:
    """Strict ISO dates: ANSI mode raises on text that is no date."""
    return df.withColumns({c: F.to_date(c, "yyyy-MM-dd") for c in (N.DATE, "expiration")})


def read_quote_zips(spark: SparkSession, folder: str, glob: str = RAW_GLOB) -> DataFrame:
    """Quotes of all matching zips. Files are read and unzipped on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option(
        "recursiveFileLookup", "true").load(folder).select("path", "content")
    return unzip_quotes(files)


def unzip_quotes(files: DataFrame) -> DataFrame:
    """(path, content) rows, batch or streaming, to typed quote rows."""
    return _typed_dates(files.mapInArrow(_unzip, _ZIP_SCHEMA))


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header line) of each CSV, for the drift check."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    return lines.filter(F.col("value").startswith(RAW_COLUMNS[0])
                        | F.col("value").startswith(f'"{RAW_COLUMNS[0]}"'))


def read_quote_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Plain CSV quote files of one column order, read splittably with an explicit schema.

    `columns` is the files' header; by default the 21 required columns. Reading fails on a
    header that differs and on values that do not parse.
    """
    header = list(columns or RAW_COLUMNS)
    problem = header_problems(header)
    if problem:
        raise ValueError(problem)
    schema = T.StructType([T.StructField(
        c, _raw_type(c) if c in RAW_COLUMNS else T.StringType()) for c in header])
    rows = spark.read.schema(schema).options(
        header=True, mode="FAILFAST", quote='"', enforceSchema=False).csv(path)
    return _typed_dates(rows.select(*RAW_COLUMNS, F.input_file_name().alias("source_zip")))


def wanted(symbols: tuple[str, ...] | None) -> Column:
    """Requested underlyings; None keeps every underlying."""
    return F.lit(True) if symbols is None else F.col(N.SYMBOL).isin(*symbols)


def bronze_rows(raw: DataFrame, symbols: tuple[str, ...] | None, start: dt.date,
                end: dt.date) -> DataFrame:
    """Requested underlyings inside the sample window."""
    return raw.filter(wanted(symbols) & F.col(N.DATE).between(F.lit(start), F.lit(end)))


ERROR_STATUSES = ("error_no_target_rows", "error_several_quote_dates", "error_null_keys")


def ingest_summary(raw: DataFrame, symbols: tuple[str, ...] | None, start: dt.date,
                   end: dt.date) -> DataFrame:
    """Per file: row counts, quote date and status, in one aggregate over the raw rows."""
    keep = wanted(symbols)
    null_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in KEY_COLUMNS])
    counted = raw.groupBy("source_zip").agg(
        F.count(F.lit(1)).alias("raw_row_count"),
        F.count_if(keep).alias("target_symbol_row_count"),
        F.min(F.when(keep, F.col(N.DATE))).alias("quote_date"),
        F.max(F.when(keep, F.col(N.DATE))).alias("_last"),
        F.count_if(keep & null_key).alias("null_key_count"))
    status = (
        F.when(F.col("target_symbol_row_count") == 0, "error_no_target_rows")
        .when(F.col("quote_date") < F.col("_last"), "error_several_quote_dates")
        .when(F.col("null_key_count") > 0, "error_null_keys")
        .when(F.col("quote_date").between(F.lit(start), F.lit(end)), "written")
        .otherwise("skipped_out_of_sample_window"))
    return counted.select(
        "source_zip", "quote_date", "raw_row_count", "target_symbol_row_count",
        (F.col("raw_row_count") - F.col("target_symbol_row_count"))
        .alias("non_target_symbol_row_count"),
        "null_key_count", status.alias("status"))


def ingest_totals(summary: DataFrame) -> DataFrame:
    return summary.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("raw_row_count").alias("raw_rows"),
        F.sum("target_symbol_row_count").alias("target_rows"),
        F.sum("non_target_symbol_row_count").alias("non_target_rows"))
