"""Daily files as a stream, the observed surface as a watermarked aggregate, and refresh."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from optionlake import names as N
from optionlake.functions.grid import SurfaceGrid, SurfaceSettings
from optionlake.functions.sqlmath import ratio
from optionlake.operators.features import FeatureSettings, feature_cells
from optionlake.sources.quotes import RAW_GLOB, bronze_rows, unzip_quotes
from optionlake.sources.tables import write_day_partitions


#: A day's folder holds one part for each zip and underlying, so other files of the day stay.
INGEST_PARTS = ("source_zip", N.SYMBOL)


def _replace_days(batch: DataFrame, _: int, path: str) -> None:
    write_day_partitions(batch, path, INGEST_PARTS)


def stream_ingest(spark: SparkSession, folder: str, bronze_path: str, checkpoint: str,
                  symbols: tuple[str, ...] | None, start: dt.date, end: dt.date,
                  glob: str = RAW_GLOB, max_files: int = 1000) -> StreamingQuery:
    """Ingest the zips that have not been ingested yet, then stop.

    The checkpoint remembers files; a batch replaces only the parts of a day that come from its
    own zips and underlyings, so a repeated batch changes nothing and other files are kept.
    """
    schema = T.StructType([
        T.StructField("path", T.StringType()), T.StructField("modificationTime",
                                                             T.TimestampType()),
        T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    files = spark.readStream.format("binaryFile").schema(schema).option(
        "pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(folder)
    rows = bronze_rows(unzip_quotes(files.select("path", "content")), symbols, start, end)
    return rows.writeStream.foreachBatch(
        lambda batch, number: _replace_days(batch, number, bronze_path)
    ).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_observed_surface(assigned: DataFrame, settings: SurfaceSettings,
                            delay: str = "1 day") -> DataFrame:
    """Vega-weighted cells of a stream of assigned quotes, one result per closed day.

    Event time is the decision instant in `decision_ts`; quotes later than the watermark are
    dropped by the engine; `late_counts` counts them. Days inside the watermark stay open when a
    stream ends: `open_days` reads them from its state.
    """
    vega = F.col("vega_1545")
    cell = settings.grid.cell_index(F.col("maturity_index"), F.col("moneyness_index"))
    return assigned.filter("inside_grid_domain").withWatermark("decision_ts", delay).groupBy(
        F.window("decision_ts", "1 day").alias("day"), N.SYMBOL, cell.alias("cell_index")).agg(
        ratio(F.sum(F.col("total_variance") * vega), F.sum(vega))
        .alias("observed_total_variance"),
        F.sum(vega).alias("vega_sum"), F.count(F.lit(1)).alias("observation_count"),
    ).select(N.SYMBOL, F.to_date("day.start").alias(N.DATE), "cell_index",
             "observed_total_variance", "vega_sum", "observation_count")


def open_days(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The days that a stopped `stream_observed_surface` has not closed, as it would emit them.

    Read from the aggregate's own state at its last commit, so nothing is read or added up again;
    together with what the stream has emitted it is the surface of every row that was not late.
    """
    # both sums are named `sum` in the state, so its fields are named anew by position
    key = f"struct<day: struct<start: timestamp, end: timestamp>, {N.SYMBOL}: string, cell_index: int>"
    sums = "struct<weighted: double, vega_sum: double, observation_count: bigint>"
    state = spark.read.format("statestore").load(checkpoint).select(
        F.col("key").cast(key).alias("k"), F.col("value").cast(sums).alias("v"))
    return state.select("k.*", "v.*").select(
        N.SYMBOL, F.to_date("day.start").alias(N.DATE), "cell_index",
        ratio(F.col("weighted"), F.col("vega_sum")).alias("observed_total_variance"),
        "vega_sum", "observation_count")


def late_counts(assigned: DataFrame, surface: DataFrame) -> DataFrame:
    """(underlying, date, n_arrived, n_counted, n_late) of the days on which quotes came too late.

    ``surface`` holds emitted and open days; both sides are added up before they meet.
    """
    arrived = assigned.filter("inside_grid_domain").groupBy(
        N.SYMBOL, F.to_date("decision_ts").alias(N.DATE)).agg(F.count(F.lit(1)).alias("n_arrived"))
    counted = surface.groupBy(*N.DAY).agg(F.sum("observation_count").alias("n_counted"))
    late = F.col("n_arrived") - F.coalesce("n_counted", F.lit(0))
    return arrived.join(counted, list(N.DAY), "left").select(
        *N.DAY, "n_arrived", F.coalesce("n_counted", F.lit(0)).alias("n_counted"),
        late.alias("n_late")).filter("n_late <> 0")


def affected_days(changed: DataFrame, days: DataFrame, max_lag: int) -> DataFrame:
    """Observed dates whose features change when the given days change.

    Those are each changed date, the following max_lag - 1 observed dates (their lags) and
    the date before it (its target). Works on the date list, not on cells.
    """
    line = Window.partitionBy(N.SYMBOL).orderBy(N.DATE)
    marked = days.select(*N.DAY).distinct().join(
        changed.select(*N.DAY).distinct().withColumn("_changed", F.lit(1)), list(N.DAY), "left")
    near = F.max("_changed").over(line.rowsBetween(1 - max_lag, 1))
    return marked.withColumn("_near", near).filter("_near = 1").select(*N.DAY)


def refresh_affected(changed: DataFrame, gold_days: DataFrame, grid: SurfaceGrid,
                     settings: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Recomputed feature cells of the dates touched by a batch of changed days.

    Only the history each touched date needs is read back, so the work follows the batch.
    """
    lag = max(max(settings.lag_windows), 2)
    touched = affected_days(changed, gold_days, lag)
    line = Window.partitionBy(N.SYMBOL).orderBy(N.DATE)
    dates = gold_days.select(*N.DAY).distinct().join(
        touched.withColumn("_hit", F.lit(1)), list(N.DAY), "left")
    needed = dates.withColumn(
        "_need", F.max("_hit").over(line.rowsBetween(-1, lag - 1))).filter("_need = 1")
    history = gold_days.join(needed.select(*N.DAY), list(N.DAY), "left_semi")
    numbered = gold_days.select(*N.DAY).distinct().withColumn(
        "_no", F.row_number().over(line))
    eligible = touched.join(numbered, list(N.DAY), "inner").filter(
        F.col("_no") >= settings.first_row).select(*N.DAY)
    return feature_cells(history, grid, settings).join(eligible, list(N.DAY), "left_semi")
