"""Candidate buckets: few pairs are verified, and the bound excludes no link."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from optionlake.llm import grouping, textbytes
from optionlake.sources.stages import StageTables


def sets(n: int, size: int = 200) -> list[set[int]]:
    """Copies of one set of features with own edits; every second one is far from all others."""
    rng = np.random.default_rng(3)
    base, made = rng.integers(1 << 48, size=size), []
    for i in range(n):
        row = base.copy()
        at = rng.choice(size, 4 if i % 2 else 60, replace=False)
        row[at] = rng.integers(1 << 48, size=len(at))
        made.append(set(row.tolist()))
    return made


def packed(rows: list[set[int]]) -> pa.RecordBatch:
    ids = [np.array(sorted(r), np.uint64) for r in rows]
    nodes = pa.array([i.to_bytes(4, "big") for i in range(len(rows))], pa.binary())
    at = np.repeat(np.arange(len(rows)), [len(x) for x in ids])
    return grouping.summary(nodes, at, np.concatenate(ids), np.ones(len(at)))


def test_bound_is_never_below_the_common_weight():
    rows = [*sets(40), set(range(5000)), set(range(2500, 9000)), {7}, {7, 8}]
    batch = packed(rows)
    spare = batch.column("spare").to_numpy()
    bits = np.array(batch.column("bits").to_pylist(), np.int64).view(np.uint64)
    assert batch.column("weight").to_pylist() == [len(r) for r in rows]
    for i, x in enumerate(rows):
        for j, y in enumerate(rows):
            bound = int(np.bitwise_count(bits[i] & bits[j]).sum()) + min(spare[i], spare[j])
            assert bound >= len(x & y)


def test_outliers_of_a_group_are_not_compared_with_all_its_members(spark):
    rows = sets(160)
    batch = packed(rows)
    members = spark.createDataFrame([(b, bytearray(n)) for b in (1, 2) for n in batch.column("node").to_pylist()],
                                    "bucket long, node binary")
    about = spark.createDataFrame(batch.to_pandas(), grouping.SUMMARY)
    verified = []

    def verify(pairs):
        found = []
        for r in pairs.collect():
            x, y = (rows[int.from_bytes(n, "big")] for n in (r.a, r.b))
            found.append((r.a, r.b, len(x & y) / len(x | y)))
        verified.append(len(found))
        return spark.createDataFrame(found, "a binary, b binary, sim double")

    groups = grouping.bucket_links(StageTables(spark), members, verify, 0.8, "t",
                                   lambda nodes: about.join(nodes, "node", "left_semi")).collect()
    # every second set is near all the others of its kind; the rest stay alone
    near = {int.from_bytes(r.node, "big") for r in groups if int.from_bytes(r.component, "big") == 1}
    assert near == set(range(1, 160, 2)) and len(groups) == 80
    assert sum(verified) < 2 * 2 * len(rows)


def test_buckets_of_two_are_done_after_the_first_comparison(spark):
    members = spark.createDataFrame([(b, bytearray([2 * b + i])) for b in range(20) for i in (0, 1)],
                                    "bucket long, node binary")
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.selectExpr("a", "b", "0D as sim")

    def summarise(nodes):
        raise AssertionError("no bucket has a pair left")

    assert grouping.bucket_links(StageTables(spark), members, verify, 0.8, "t", summarise).isEmpty()
    assert asked == [20]


def test_buckets_of_five_are_done_after_four_leaders(spark):
    members = spark.createDataFrame([(b, bytearray([8 * b + i])) for b in range(3) for i in range(5)],
                                    "bucket long, node binary")
    seen = []

    def verify(pairs):
        seen.append({frozenset((bytes(r.a), bytes(r.b))) for r in pairs.collect()})
        return pairs.selectExpr("a", "b", "0D as sim")

    assert grouping.bucket_links(StageTables(spark), members, verify, 0.8, "t").isEmpty()
    assert len(set().union(*seen)) == 3 * 10 and len(seen) == 2


def test_distinct_keys():
    keys = np.random.default_rng(1).integers(0, 500, 2000).astype(np.uint64) << np.uint64(40)
    assert textbytes.distinct(keys.copy()).tolist() == sorted(set(keys.tolist()))
    assert textbytes.distinct(np.empty(0, np.uint64)).tolist() == []
