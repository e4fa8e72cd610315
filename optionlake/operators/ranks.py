"""Exact percentiles of large groups without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from optionlake.sources.stages import StageTables


def percentiles(stages: StageTables, rows: DataFrame, keys: Sequence[str], column: str,
                shares: Sequence[float], name: str, ranges: int = 1024,
                held: int = 65_536) -> DataFrame:
    """(keys, share, value, n): interpolated percentiles of the non-null values of each group.

    Values are counted once, so ties travel as one row. Each wanted rank keeps the value range it
    lies in; a pass counts the values of ``ranges`` parts of every open range, by an aggregation that
    combines before its shuffle, and keeps the part that holds the rank. When no range has more
    than ``held`` distinct values left, those are ranked by a window. Every pass narrows a range to
    fewer distinct values, so the passes end. Groups without values do not appear. Null keys are a
    group. NaN and infinite values raise.
    """
    x = F.col(column).cast("double")
    finite = F.when((x == x) & (F.abs(x) < float("inf")), x).otherwise(
        F.raise_error(f"{column} is not finite").cast("double"))
    names = [f"key{i}" for i in range(len(keys))]
    counted = stages.get(f"{name}-values", lambda: rows.filter(x.isNotNull()).groupBy(
        *[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)], (finite + 0.0).alias("x")).agg(
            F.count(F.lit(1)).alias("n")))
    # one row for each rank on either side of a percentile; few rows, so joins can ship them
    at = (F.col("total") - 1) * F.col("share")
    wanted = stages.get(f"{name}-ranks-0", lambda: counted.groupBy(*names).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"),
        F.min("x").alias("low"), F.max("x").alias("high")).withColumn(
            "share", F.explode(F.array(*map(F.lit, map(float, shares))))).withColumn(
            "side", F.explode(F.array(F.lit(0), F.lit(1)))).select(
            *names, "share", "side", "total", "distinct", "low", "high",
            F.when(F.col("side") == 0, F.floor(at)).otherwise(F.ceil(at)).alias("rank")))
    own = [*names, "share", "side"]
    is_open, number = (F.col("distinct") > held) & (F.col("low") < F.col("high")), 0

    def within(table: DataFrame) -> DataFrame:
        """The values in each row's range."""
        v, r = counted.alias("v"), table.alias("r")
        same = F.lit(True)
        for k in names:
            same = same & F.col(f"v.{k}").eqNullSafe(F.col(f"r.{k}"))
        return v.join(r, same & F.col("v.x").between(F.col("r.low"), F.col("r.high"))).select(
            "r.*", "v.x", "v.n")

    while not wanted.filter(is_open).isEmpty():
        number += 1
        # the width of a range may overflow; that of the halved ends does not
        scale = F.when(F.col("high") - F.col("low") < float("inf"), 1.0).otherwise(0.5)
        low, high = F.col("low") * scale, F.col("high") * scale
        part = F.floor((F.col("x") * scale - low) / (high - low) * ranges)
        before = F.sum("n").over(W.partitionBy(*own).orderBy("part")) - F.col("n")
        wanted = stages.get(f"{name}-ranks-{number}", lambda t=wanted: within(
            t.filter(is_open)).groupBy(*own, "total", "rank", F.least(part, F.lit(ranges - 1)).alias(
                "part")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"),
                             F.min("x").alias("low"), F.max("x").alias("high")).withColumn(
            "before", before).filter("rank >= before and rank < before + n").select(
                *own, "total", "distinct", "low", "high",
                (F.col("rank") - F.col("before")).alias("rank")).unionByName(t.filter(~is_open)))
    last = F.sum("n").over(W.partitionBy(*own).orderBy("x"))
    found = within(wanted).withColumn("last", last).filter(
        "rank < last and rank >= last - n").groupBy(*names, "share").agg(
            F.max(F.when(F.col("side") == 0, F.col("x"))).alias("below"),
            F.max(F.when(F.col("side") == 1, F.col("x"))).alias("above"),
            F.max("total").alias("total"))
    part_above = at - F.floor(at)
    return found.select(
        *[F.col(a).alias(k) for k, a in zip(keys, names, strict=True)], "share",
        (F.col("below") * (1 - part_above) + F.col("above") * part_above).alias("value"),
        F.col("total").alias("n"))
