"""Links inside candidate buckets and the groups they make, without emitting all pairs.

Every bucket first compares its members with one leader, the member that meets the most others over
all its buckets: it is likely to be the middle of a group. The links join most of a group up, and a
bucket of two is done. After that only pairs of different groups matter, in larger buckets that still
hold several. Four more leaders each and then, in buckets of more than five, all such pairs are
compared, but only pairs that an upper bound of their similarity lets pass:
each node has a bitmap of its hashed features, and a bit that one node has alone is a feature
that the other lacks. The bound is part of the join, so pairs below it are never written, shuffled or
verified, and in the last step a pair comes from its first common bucket only. No pair of a bucket
that reaches the threshold is lost, other than between nodes which are already connected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from optionlake.deploy import RUNTIME_OPTIONS
from optionlake.llm import textbytes
from optionlake.sources.stages import StageTables

BITS = 2048
#: What ``summarise`` of ``bucket_links`` returns.
SUMMARY = "node binary, weight double, spare double, bits array<long>"
_LEADERS = 4
_ROUNDING = 0.001


def components(stages: StageTables, edges: DataFrame, name: str) -> DataFrame:
    """(node, component): component is the smallest node that is connected with the node.

    Alternates large-star and small-star steps on ``edges`` (a, b), each round a stage table,
    until all edges form stars. Only nodes with an edge appear. Nulls and loops are ignored.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"),
                                          F.least("a", "b").alias("v")).distinct()
    number = 0
    table = stages.get(f"{name}-0", lambda: pairs)
    while not _all_stars(table):
        number += 1
        table = stages.get(f"{name}-{number}", lambda t=table: _star(t))
    return table.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        table.select("v", "v")).distinct()


def _all_stars(table: DataFrame) -> bool:
    """Whether each u has one edge and no v is a u as well."""
    ends = table.select(F.col("u").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(
        table.select("v", F.lit(0), F.lit(1)))
    found = ends.groupBy("n").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return found.filter("low + high > 1").isEmpty()


def _star(table: DataFrame) -> DataFrame:
    """One large-star step and one small-star step on edges u > v."""
    both = table.select("u", "v").union(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select("u", F.col("m").alias("v"))).distinct()


def summary(nodes: pa.Array, rows: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    """Rows of SUMMARY from the distinct features of each row and their weights of 1 or more.

    ``spare`` is the weight less the number of bits set: two nodes share at most the smaller spare and
    one for each common bit.
    """
    keys = textbytes.distinct(rows.astype(np.uint64) * np.uint64(BITS) + ids % np.uint64(BITS))
    words = (keys >> np.uint64(6)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else words
    bits = np.zeros(len(nodes) * (BITS // 64), np.uint64)
    if len(first):
        bits[words[first]] = np.bitwise_or.reduceat(np.uint64(1) << (keys & np.uint64(63)), first)
    total = np.bincount(rows, weights, len(nodes))
    ones = np.bincount((keys // np.uint64(BITS)).astype(np.int64), minlength=len(nodes))
    ends = np.arange(len(nodes) + 1, dtype=np.int32) * (BITS // 64)
    return pa.record_batch({"node": nodes, "weight": total, "spare": total - ones,
                            "bits": pa.ListArray.from_arrays(ends, bits.view(np.int64))})


def _may_reach(threshold: float) -> str:
    """Whether x and y, rows with a SUMMARY, can share enough weight; never false for a link."""
    common = " + ".join(f"bit_count(get(x.bits, {i}) & get(y.bits, {i}))" for i in range(BITS // 64))
    part = threshold / (1 + threshold)
    return (f"x.group <> y.group and least(x.weight, y.weight) >= {part!r}D * (x.weight + y.weight)"
            f" - {_ROUNDING}D and {common} + least(x.spare, y.spare) >= "
            f"{part!r}D * (x.weight + y.weight) - {_ROUNDING}D")


def _ordered(left: str, right: str):
    return F.least(left, right).alias("a"), F.greatest(left, right).alias("b")


def bucket_links(
    stages: StageTables,
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    threshold: float,
    name: str,
    summarise: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(node, component) from ``members`` (bucket, node), a row once.

    ``verify`` takes pairs (a, b) and returns (a, b, sim) with their similarity, shared by joint
    weight. ``summarise`` takes nodes (node) and returns SUMMARY, made by ``summary``; without it no pair is
    excluded by the bound.
    """
    # the bound is a long expression: inlined in a join it is never compiled by the JVM
    limit = "spark.sql.codegen.hugeMethodLimit"
    stages.spark.conf.set(limit, RUNTIME_OPTIONS[limit])
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    sized = stages.get(f"{name}-sized", lambda: members.join(sizes, "bucket"))
    met = sized.groupBy("node").agg(F.sum("n").alias("met"))
    ranked = stages.get(f"{name}-ranked", lambda: sized.join(met, "node").select(
        "bucket", "node", "n", "met"))
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("met", "node")).alias("leader")).select(
        "bucket", F.col("leader.node").alias("leader"))

    def links(pairs: DataFrame) -> DataFrame:
        return verify(pairs).filter(F.col("sim") >= threshold).select("a", "b")

    def mixed(rows: DataFrame, groups: DataFrame) -> DataFrame:
        rows = rows.select("bucket", "node", "n", "met").join(
            groups.withColumnRenamed("component", "group"), "node", "left").withColumn(
                "group", F.coalesce("group", "node"))
        several = rows.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high"))
        return rows.join(several.filter("low < high"), "bucket", "left_semi")

    led = stages.get(f"{name}-led", lambda: links(ranked.join(leaders, "bucket").filter(
        "node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()))
    groups = components(stages, led, f"{name}-groups-0")
    left = stages.get(f"{name}-mixed-0", lambda: mixed(ranked.filter("n > 2"), groups))
    if left.isEmpty():
        return groups
    nodes = left.select("node").distinct()
    about = stages.get(f"{name}-about", lambda: summarise(nodes) if summarise else nodes)
    apart = _may_reach(threshold) if summarise else "x.group <> y.group"
    rank = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("met"), "node"))
    some = left.withColumn("rank", rank).filter(F.col("rank") <= _LEADERS).join(about, "node")
    more = stages.get(f"{name}-more", lambda: links(some.alias("x").join(
        left.join(about, "node").alias("y"), F.expr(f"x.bucket = y.bucket and {apart}")).select(
            *_ordered("x.node", "y.node")).distinct()))
    stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    groups = components(stages, stars.union(more), f"{name}-groups-1")
    rest = stages.get(f"{name}-mixed-1", lambda: mixed(
        left.filter(F.col("n") > _LEADERS + 1), groups))
    if rest.isEmpty():
        return groups
    own = rest.groupBy("node").agg(F.collect_set("bucket").alias("own")).join(about, "node")
    rows = rest.select("bucket", "node", "group").join(own, "node")
    last = stages.get(f"{name}-last", lambda: links(rows.alias("x").join(rows.alias("y"), F.expr(
        f"x.bucket = y.bucket and x.node < y.node and {apart} "
        "and x.bucket = array_min(array_intersect(x.own, y.own))")).select(
            F.col("x.node").alias("a"), F.col("y.node").alias("b"))))
    stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(stages, stars.union(last), f"{name}-all")
