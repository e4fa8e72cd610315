"""Stage tables: results that several later steps read are written once to shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession

from optionlake.operators.gate import Gate


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a private one only for local sessions."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="spark-")


class StageTables:
    """Named parquet tables of one run. A lost executor re-reads them; nothing is cached."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = f"{folder or shared_folder(spark)}/stages-{uuid.uuid4().hex}"
        self._written: set[str] = set()
        #: What the gates of the written stages observed.
        self.observed: dict[str, dict] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def get(self, name: str, build: Callable[[], DataFrame],
            gate: Callable[[], Gate] | None = None) -> DataFrame:
        """The table, written on first use; one that breaks its gate raises and is not kept."""
        if name not in self._written:
            table, checks = build(), gate() if gate else None
            watch = Observation()
            if checks:
                table = table.observe(watch, *checks.columns())
            table.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
            if checks:
                self.observed[name] = dict(watch.get)
                checks.judge(self.observed[name])
            self._written.add(name)
        return self.spark.read.parquet(self.path(name))
