"""Benchmark passages in documents: the q-gram lemma over diagonal bands, then banded alignment.

Texts are compared by code point, with A-Z lowered and each white-space character as a space. An
item of m characters has an edit budget k (a share of m, at most what the lemma allows). A region
of a document within k edits of the item shares at least m + 1 - (k + 1) q of its character
q-grams, on diagonals (document position minus item position) that differ by at most k. So shared
q-grams are counted in overlapping bands of diagonals; bands that reach the bound are verified by
semi-global alignment inside the band. Items shorter than ``q`` must occur exactly.

The benchmark is the stated query set. It is worked through in blocks of bounded size, each
looked up in every whole document; a block's index goes to the tasks with their code. Documents
are never shuffled. Null or blank items match nothing, and null texts have no matches. Repeated
rows come out repeated; repeated items each match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optionlake.llm import textbytes

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


@dataclass(frozen=True)
class MatchSettings:
    """``block_chars`` bounds the benchmark text that is indexed at a time."""

    q: int = 10
    budget: float = 0.07
    block_chars: int = 4_000_000


def folded(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes, case and white space folded."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    return np.where(points < 256, _FOLD[np.minimum(points, 255)], points)


def allowed(m: int, settings: MatchSettings) -> int:
    """The edit budget of an item: the share, and at least one q-gram must be left to share."""
    return max(0, min(int(settings.budget * m), m // settings.q - 1))


class Index:
    """The q-grams of a block of items, sorted by fingerprint, behind a small bitmap."""

    def __init__(self, items: list[tuple[int, str]], settings: MatchSettings) -> None:
        self.q, self.settings = settings.q, settings
        self.ids = [i for i, _ in items]
        self.texts = [folded(np.frombuffer(t.encode(), np.uint8)) for _, t in items]
        self.budgets = np.array([allowed(len(t), settings) for t in self.texts], np.int64)
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.bounds = np.maximum(1, lengths + 1 - (self.budgets + 1) * self.q)
        self.short = [i for i, t in enumerate(self.texts) if len(t) < self.q]
        grams, items_, places = [], [], []
        for i, text in enumerate(self.texts):
            at = np.arange(max(0, len(text) - self.q + 1))
            grams.append(self.grams(text, at))
            items_.append(np.full(len(at), i))
            places.append(at)
        joined = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.sorted = joined[order]
        self.items = np.concatenate(items_)[order].astype(np.int64) if items_ else order
        self.places = np.concatenate(places)[order].astype(np.int64) if places else order
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.sorted >> np.uint64(42)).astype(np.int64)] = True

    def grams(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        return textbytes.Rolling(points.astype(np.uint64) + np.uint64(1)).spans(at, at + self.q)

    def hits(self, points: np.ndarray, bounds: np.ndarray):
        """(row, item, position in the text, position in the item) of shared q-grams."""
        grams = self.grams(points, np.arange(max(0, len(points) - self.q + 1)))
        at = np.flatnonzero(self.bits[(grams >> np.uint64(42)).astype(np.int64)])
        low = np.searchsorted(self.sorted, grams[at], "left")
        count = np.searchsorted(self.sorted, grams[at], "right") - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        row = np.searchsorted(bounds, at, "right") - 1
        inside = at + self.q <= bounds[row + 1]
        at, low, count, row = at[inside], low[inside], count[inside], row[inside]
        pick = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return (np.repeat(row, count), self.items[pick], np.repeat(at - bounds[row], count),
                self.places[pick])

    def regions(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows (row, item, band) whose band of diagonals holds enough q-grams."""
        row, item, i, j = self.hits(points, bounds)
        band = (i - j) // (self.budgets[item] + 1)
        both = np.stack([np.tile(row, 2), np.tile(item, 2), np.concatenate([band, band - 1])], 1)
        found, count = np.unique(both, axis=0, return_counts=True)
        return found[count >= self.bounds[found[:, 1]]]


def align(item: np.ndarray, text: np.ndarray, low: int, width: int, budget: int):
    """(edits, start, end) of the best placing of ``item`` on diagonals low..low+width-1, or None.

    One row of the band per item character; starts are free, and ties go to the earliest end.
    """
    big = budget + 1
    offsets = low + np.arange(width)
    shift = width - min(low, 0)
    padded = np.full(shift + max(len(text), low + width + len(item)) + 1, 0xFFFFFFFF, np.uint32)
    padded[shift:shift + len(text)] = text
    cost = np.where((offsets >= 0) & (offsets <= len(text)), 0, big).astype(np.int64)
    start = offsets.copy()
    ramp = np.arange(width)
    for r, c in enumerate(item):
        here = padded[shift + low + r:shift + low + r + width]
        step = cost + (here != c)
        step[here == 0xFFFFFFFF] = big
        drop = np.append(cost[1:] + 1, big)
        came = np.where(drop < step, np.append(start[1:], 0), start)
        best = np.minimum(step, drop)
        run = np.minimum.accumulate(best - ramp)
        source = np.maximum.accumulate(np.where(best - ramp == run, ramp, 0))
        cost = np.minimum(run + ramp, big)
        start = came[source]
        if cost.min() >= big:
            return None
    ends = offsets + len(item)
    cost[(ends < 0) | (ends > len(text))] = big
    at = int(cost.argmin())
    return None if cost[at] > budget else (int(cost[at]), int(start[at]), int(ends[at]))


def _matches(index: Index):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "item_id", "start", "end", "edits")}
            for low, _, chunk in textbytes.chunks(batch.column("text")):
                points = folded(chunk.data)
                heads = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
                bounds = heads[chunk.bounds]
                best: dict[tuple[int, int, int], tuple[int, int, int]] = {}
                for row, item, band in index.regions(points, bounds).tolist():
                    k = int(index.budgets[item])
                    text = points[bounds[row]:bounds[row + 1]]
                    found = align(index.texts[item], text, band * (k + 1) - k,
                                  2 * (k + 1) + 2 * k, k)
                    if found and found < best.get((row, item, found[1] // (k + 1)), (1 << 60,)):
                        best[row, item, found[1] // (k + 1)] = found
                for item in index.short:
                    wanted = index.texts[item].tobytes()
                    for row in range(chunk.rows) if wanted.strip(b" \0") else ():
                        text = points[bounds[row]:bounds[row + 1]].tobytes()
                        at = text.find(wanted)
                        while at >= 0:
                            if at % 4 == 0:
                                best[row, item, at // 4] = 0, at // 4, (at + len(wanted)) // 4
                            at = text.find(wanted, at + 1)
                last: dict[tuple[int, int], tuple[int, int, int]] = {}
                for (row, item, _), found in sorted(best.items(), key=lambda x: (x[0][:2], x[1][1])):
                    seen = last.get((row, item))
                    if seen and found[1] < seen[2]:  # the same region, seen from two bands
                        if found[0] >= seen[0]:
                            continue
                        for values in out.values():
                            values.pop()
                    last[row, item] = found
                    for values, value in zip(out.values(), (
                            low + row, index.ids[item], found[1], found[2], found[0]), strict=True):
                        values.append(value)
            ids = batch.column("doc_id").take(pa.array(out.pop("row"), pa.int64()))
            yield pa.record_batch({"doc_id": ids} | {k: pa.array(v, pa.int64()) for k, v in out.items()})
    return build


MATCH = "doc_id long, item_id long, start long, end long, edits long"


def contaminations(spark: SparkSession, docs: DataFrame, benchmark: DataFrame,
                   settings: MatchSettings = MatchSettings()) -> DataFrame:
    """One row per region: doc_id, item_id, start and end (code points, exclusive), edits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(
        "length(trim(text)) > 0")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // settings.block_chars)
    block = F.pmod(F.xxhash64("text", F.lit(23)), F.lit(max(1, blocks)))
    found = spark.createDataFrame([], MATCH)
    for number in range(blocks):
        part = [(r.item_id, r.text) for r in items.filter(block == number).toLocalIterator()]
        found = found.union(rows.mapInArrow(_matches(Index(part, settings)), MATCH))
    return found


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame,
                    settings: MatchSettings = MatchSettings()) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found."""
    # one key of both, as ids may be null or shared by other texts
    key = F.xxhash64(docs["doc_id"], docs["text"].cast("string"))
    hit = contaminations(spark, docs.select(key.alias("doc_id"), "text"), benchmark, settings)
    hit = hit.select(F.col("doc_id").alias("hit_key")).distinct()
    return docs.join(hit, key == hit["hit_key"], "left_anti")
