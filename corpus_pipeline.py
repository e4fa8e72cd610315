"""A corpus pipeline: quality, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optionlake.deploy import ship_package
from optionlake.llm import decontaminate, lines, minhash, packing, quality
from optionlake.sources.stages import StageTables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The stages have no SQL: fitted models, sketches, edit distances and token ids.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship_package(spark)
    settings = quality.QualitySettings()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.trained(spark, docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0,
                            settings)
    return quality.scored(docs, model).filter(
        F.col("quality_score") >= settings.cut).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are similar to an earlier line."""
    ship_package(spark)
    return lines.clean_lines(spark, docs).withColumn(
        "n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship_package(spark)
    return minhash.representatives(spark, docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    ship_package(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean_documents(spark, docs, benchmark).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left."""
    ship_package(spark)
    return packing.packed(spark, docs, *packing.public_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each a Parquet table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = StageTables(spark)
    for number, (_, stage) in enumerate(STAGES):
        docs = tables.get(f"stage-{number}", lambda s=stage, d=docs: s(spark, d, sf_dir))
    return docs
