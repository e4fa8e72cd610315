"""Hard-negative mining: integer scores by Strassen multiplication of tiles, merged as heaps.

Rows are packed where they lie into blocks of at most ``block`` rows, whatever their keys, so hot
labels or repeated vectors never share a group. Anchors are packed into blocks of their own. Every
(anchor block, candidate block) tile is one group of a shuffle: its scores come from a Strassen
product, and only bounded heaps leave it. Two passes over the tiles are merged by Spark:

1. positive heaps: the first ``positives`` rows of the anchor's label, other ids, in each tile;
2. window heaps: for each positive, the first ``negatives`` rows of other labels whose score lies
   between ``low`` and ``high`` per cent of the positive's score.

Heaps are ordered by descending score, then by ascending id; merging two heaps keeps the first k of
both, so the result does not depend on blocks. The work is anchors x rows, as a search needs; the
tables shuffled are blocks, each repeated once per block of the other side.

Arithmetic is exact: additions, subtractions and products of int64 are exact modulo 2**64 at every
level, and a tile whose scores could leave int64 raises. Vectors of different sizes are padded
with zeros. Rows with a null id, label or vector, or a null or non-finite component, take no part;
a component beyond int64 after scaling raises. Repeated rows are candidates each; equal anchors
are one anchor. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from optionlake.sources.stages import StageTables


@dataclass(frozen=True)
class MiningSettings:
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    block: int = 2048
    anchor_block: int = 512
    leaf: int = 16


def strassen(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """``a @ b`` of int64 matrices, modulo 2**64, by seven products of halves at each level.

    Odd sides are padded with a zero row or column; the recursion ends at sides up to ``leaf``.
    """
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return np.einsum("ik,kj->ij", a, b)
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, w, v = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :w], a[:h, w:], a[h:, :w], a[h:, w:]
    b11, b12, b21, b22 = b[:w, :v], b[:w, v:], b[w:, :v], b[w:, v:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * v), np.int64)
    out[:h, :v] = p1 + p4 - p5 + p7
    out[:h, v:] = p3 + p5
    out[h:, :v] = p2 + p4
    out[h:, v:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def integer_rows(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part; components become floor(scale * x)."""
    whole = "vec_id is not null and label is not null and embedding is not null and forall(" \
            "embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) <> double('inf'))"
    vector = f"transform(embedding, x -> if(abs({scale} * cast(x as double)) < 9.2e18D, " \
             f"cast(floor({scale} * cast(x as double)) as bigint), " \
             "cast(raise_error('a component does not fit int64') as bigint)))"
    return rows.filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"),
                                     F.col("label").cast("long").alias("label"),
                                     F.expr(vector).alias("vector"))


BLOCK = "part long, seq long, n int, ids binary, labels binary, sizes binary, values binary"


def _blocks(size: int):
    """Packs the rows of a partition into block rows."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                piece = batch.slice(low, size)
                vectors = piece.column("vector")
                sizes = np.diff(vectors.offsets.to_numpy())
                yield pa.record_batch({
                    "part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()),
                    "n": pa.array([piece.num_rows], pa.int32()),
                    "ids": pa.array([piece.column("vec_id").to_numpy().tobytes()], pa.binary()),
                    "labels": pa.array([piece.column("label").to_numpy().tobytes()], pa.binary()),
                    "sizes": pa.array([sizes.astype(np.int64).tobytes()], pa.binary()),
                    "values": pa.array([vectors.flatten().to_numpy().tobytes()], pa.binary())})
                seq += 1
    return build


def _matrix(sizes: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """One row per vector, padded with zeros on the right."""
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


class _Side:
    """The rows of a group's blocks, in order of id."""

    def __init__(self, table: pa.Table) -> None:
        ids, labels, sizes, values = (
            [np.frombuffer(v.as_py(), np.int64) for v in table.column(k)]
            for k in ("ids", "labels", "sizes", "values"))
        width = max([1, *(int(s.max()) for s in sizes if len(s))])
        every = np.concatenate([_matrix(s, v, width) for s, v in zip(sizes, values, strict=True)])
        owner = np.concatenate([
            np.stack([np.full(len(i), p), np.full(len(i), q), np.arange(len(i))], 1)
            for i, p, q in zip(ids, table.column("part").to_pylist(),
                               table.column("seq").to_pylist(), strict=True)])
        ids = np.concatenate(ids)
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], np.concatenate(labels)[order]
        self.matrix, self.owner = every[order], owner[order]


def tile_scores(left: np.ndarray, right: np.ndarray, leaf: int) -> np.ndarray:
    """Inner products of the rows of both matrices; raises if one could leave int64."""
    width = max(left.shape[1], right.shape[1])
    left = np.pad(left, ((0, 0), (0, width - left.shape[1])))
    right = np.pad(right, ((0, 0), (0, width - right.shape[1])))
    # min and max, not abs: the absolute value of the least int64 is no int64
    peaks = [max(int(x.max()), -int(x.min())) if x.size else 0 for x in (left, right)]
    if width * peaks[0] * peaks[1] >= 1 << 63:
        raise OverflowError("inner products of these vectors do not fit int64")
    return strassen(left, np.ascontiguousarray(right.T), leaf)


def descending(scores: np.ndarray, allowed: np.ndarray, count: int | None) -> np.ndarray:
    """Per row, columns in order of descending score, then column; those not allowed come last.

    With ``count``, only that many first columns, at least.
    """
    n = scores.shape[1]
    bits = max(1, int(n - 1).bit_length())
    peak = max(int(scores.max()), -int(scores.min())) if scores.size else 0
    if peak < 1 << (61 - bits):
        # score and column in one integer, so that plain sorting breaks ties by column
        keys = np.where(allowed, -scores << bits | np.arange(n), 1 << 62 | np.arange(n))
        if count is not None and count < n:
            keys = np.partition(keys, count - 1, axis=1)[:, :count]
        keys.sort(axis=1)
        return keys & ((1 << bits) - 1)
    order = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), ~scores, ~allowed), axis=1)
    return order


def _positive_heaps(settings: MiningSettings):
    def tile(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in (
            "part", "seq", "slot", "anchor_id", "positive_id", "score")}
        if anchors.num_rows and candidates.num_rows:
            a, c = _Side(anchors), _Side(candidates)
            scores = tile_scores(a.matrix, c.matrix, settings.leaf)
            allowed = (a.labels[:, None] == c.labels) & (a.ids[:, None] != c.ids)
            order = descending(scores, allowed, settings.positives)[:, :settings.positives]
            row = np.repeat(np.arange(len(a.ids)), order.shape[1])
            column = order.reshape(-1)
            good = allowed[row, column]
            row, column = row[good], column[good]
            values = (*a.owner[row].T, a.ids[row], c.ids[column], scores[row, column])
            out = dict(zip(out, values, strict=True))
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})
    return tile


def _window_heaps(settings: MiningSettings):
    low, high = settings.low, settings.high

    def tile(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in (
            "part", "seq", "slot", "place", "negative_id", "score")}
        if anchors.num_rows and candidates.num_rows:
            a, c = _Side(anchors), _Side(candidates)
            scores = tile_scores(a.matrix, c.matrix, settings.leaf)
            allowed = a.labels[:, None] != c.labels
            order = descending(scores, allowed, None)
            counts = allowed.sum(axis=1)
            at = {tuple(o): i for i, o in enumerate(a.owner.tolist())}
            wanted = ((part, seq, *entry.values()) for part, seq, entries in zip(
                anchors["part"].to_pylist(), anchors["seq"].to_pylist(),
                anchors["wanted"].to_pylist(), strict=True) for entry in entries or ())
            ranked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for part, seq, slot, place, score in wanted:
                i = at[part, seq, slot]
                if i not in ranked:
                    columns = order[i, :counts[i]]
                    ranked[i] = columns, ~scores[i, columns]  # ~x ascends as x descends
                columns, falling = ranked[i]
                # Python integers, so that the products with per cents are exact
                top, least = high * score // 100, -(-low * score // 100)
                first = int(np.searchsorted(falling, ~top))
                end = int(np.searchsorted(falling, ~least, side="right"))
                for j in columns[first:min(end, first + settings.negatives)]:
                    row = part, seq, slot, place, int(c.ids[j]), int(scores[i, j])
                    for values, value in zip(out.values(), row, strict=True):
                        values.append(value)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})
    return tile


def _tiles(anchors: DataFrame, candidates: DataFrame, grid: tuple[int, int], heaps, schema: str):
    """Applies ``heaps`` to each tile: both kinds of blocks, once for every block of the other."""
    rows, columns = grid
    own = F.pmod(F.xxhash64("part", "seq"), F.lit(rows)).alias("i")
    left = anchors.select("*", own, F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"))
    own = F.pmod(F.xxhash64("part", "seq"), F.lit(columns)).alias("j")
    right = candidates.select("*", own, F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("i"))
    keys = [F.col("i").cast("long"), F.col("j").cast("long")]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(heaps, schema)


def _first(heaps: DataFrame, keys: list[str], id_column: str, count: int) -> DataFrame:
    """Merges heaps: the first ``count`` entries of each key, with their rank from 1."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), id_column)
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def hard_negatives(spark: SparkSession, rows: DataFrame, is_anchor: Column,
                   settings: MiningSettings = MiningSettings()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, label and embedding; ``is_anchor`` is a condition on vec_id and label.
    Positives without a row in their window do not appear.
    """
    stages = StageTables(spark)
    whole = integer_rows(rows, settings.scale)
    candidates = stages.get("candidates", lambda: whole.mapInArrow(_blocks(settings.block), BLOCK))
    chosen = whole.filter(is_anchor).dropDuplicates(["vec_id", "label", "vector"])
    anchors = stages.get("anchors", lambda: chosen.mapInArrow(
        _blocks(settings.anchor_block), BLOCK))

    def parts(blocks: DataFrame, size: int) -> int:
        total = blocks.agg(F.sum("n")).first()[0] or 0
        return max(1, -(-total // size))

    grid = parts(anchors, settings.anchor_block), parts(candidates, settings.block)
    heaps = _tiles(anchors, candidates, grid, _positive_heaps(settings), "part long, seq long, "
                   "slot long, anchor_id long, positive_id long, score long")
    best = stages.get("positives", lambda: _first(
        heaps, ["part", "seq", "slot"], "positive_id", settings.positives))
    wanted = best.groupBy("part", "seq").agg(F.collect_list(F.struct(
        "slot", F.col("rank").cast("long").alias("place"), "score")).alias("wanted"))
    heaps = _tiles(anchors.join(wanted, ["part", "seq"]), candidates, grid, _window_heaps(settings),
                   "part long, seq long, slot long, place long, negative_id long, score long")
    found = _first(heaps, ["part", "seq", "slot", "place"], "negative_id", settings.negatives)
    positives = best.select("part", "seq", "slot", F.col("rank").cast("long").alias("place"),
                            "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    return found.join(positives, ["part", "seq", "slot", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score",
        F.col("score").alias("negative_score"))
