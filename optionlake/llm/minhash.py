"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF word shingles.

A shingle is five consecutive words (a shorter text is one shingle). Its weight is
``(1 + ln tf) * (1 + idf_strength * ln((N+1)/(df+1)) / ln(N+1))``; document frequencies are counted
over all documents in 2**20 hashed features, as a hashing vectoriser does. Each text is sketched
with ``bands * rows`` consistent weighted samples; texts that agree in a band are compared by the
weighted Jaccard similarity of their whole shingle sets. Equal texts are one node from the start.

Null texts are in no group. Empty texts, and texts without words, have no shingles: only equal
ones are grouped. Repeated rows come out repeated, with one class. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optionlake.llm import textbytes
from optionlake.llm.grouping import SUMMARY, bucket_links, summary
from optionlake.sources.stages import StageTables

FEATURE_BITS = 20
_ID_BITS = 48
_LOW = np.uint64(0xFFFF)
_SUMMARY_ROWS = 256


@dataclass(frozen=True)
class NearSettings:
    """``idf_strength`` bounds how far rare shingles outweigh common ones (1 : 1 + strength)."""

    width: int = 5
    threshold: float = 0.8
    bands: int = 16
    rows: int = 5
    idf_strength: float = 0.25


def shingles(chunk: textbytes.Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 48-bit id of each shingle occurrence, sorted by row and id."""
    words = chunk.word_hashes()
    starts, rows = chunk.window_starts(width)
    short = np.flatnonzero((chunk.n_words > 0) & (chunk.n_words < width))
    low = np.concatenate([starts, chunk.word_bounds[:-1][short]])
    high = np.concatenate([starts + width, chunk.word_bounds[1:][short]])
    ids = textbytes.Rolling(words, 1).spans(low, high) >> np.uint64(64 - _ID_BITS)
    keys = np.concatenate([rows, short]).astype(np.uint64) << np.uint64(_ID_BITS) | ids
    keys.sort()
    return (keys >> np.uint64(_ID_BITS)).astype(np.int64), keys & np.uint64((1 << _ID_BITS) - 1)


def weighted(rows: np.ndarray, ids: np.ndarray, idf: np.ndarray):
    """Distinct shingles of each row with their weights."""
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(ids)))
    ids, rows = ids[at], rows[at]
    weights = idf[(ids >> np.uint64(_ID_BITS - FEATURE_BITS)).astype(np.int64)]
    return rows, ids, weights * (1 + np.log(count, dtype=np.float32))


def _sampling_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), their logarithms and uniforms at 2**16 midpoints."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    grid = np.geomspace(1e-4, 40, 200_000)
    quantiles = np.interp(u, 1 - (1 + grid) * np.exp(-grid), grid)
    return (quantiles.astype(np.float32), np.log(quantiles).astype(np.float32),
            u.astype(np.float32))


def sketch(rows: np.ndarray, ids: np.ndarray, weights: np.ndarray, count: int):
    """(rows with shingles, their ``count`` samples); a sample is a mixed (shingle, level)."""
    gamma, log_gamma, uniform = _sampling_tables()
    begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    lengths = np.diff(np.append(begin, len(rows)))
    logs = np.log(weights)
    out = np.empty((len(begin), count), np.uint64)
    seeds = textbytes.mix(np.arange(1, count + 1, dtype=np.uint64))
    for k in range(count):
        x = textbytes.mix(ids ^ seeds[k])
        r = gamma[(x & _LOW).astype(np.int64)]
        beta = uniform[(x >> np.uint64(16) & _LOW).astype(np.int64)]
        level = np.floor(logs / r + beta)
        cost = log_gamma[(x >> np.uint64(32) & _LOW).astype(np.int64)] - r * (level - beta + 1)
        best = np.flatnonzero(cost == np.repeat(np.minimum.reduceat(cost, begin), lengths))
        best = best[np.unique(rows[best], return_index=True)[1]]
        out[:, k] = textbytes.mix(ids[best] ^ level[best].astype(np.int64).view(np.uint64)
                                  << np.uint64(_ID_BITS))
    return rows[begin], out


def document_frequencies(docs: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts with each hashed feature; the table has a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << FEATURE_BITS, np.int64)
        texts = 0
        for batch in batches:
            for _, _, chunk in textbytes.chunks(batch.column(0)):
                rows, ids = shingles(chunk, width)
                features = ids >> np.uint64(_ID_BITS - FEATURE_BITS)
                new = np.ones(len(ids), bool)
                new[1:] = (features[1:] != features[:-1]) | (rows[1:] != rows[:-1])
                seen += np.bincount(features[new].astype(np.int64), minlength=len(seen))
                texts += chunk.rows
        at = np.flatnonzero(seen)
        yield pa.record_batch({"feature": np.append(at, -1).astype(np.int32),
                               "n": np.append(seen[at], texts)})

    table = docs.select("text").filter("text is not null").mapInArrow(
        count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    at, n = table["feature"].to_numpy(), table["n"].to_numpy()
    seen = np.zeros(1 << FEATURE_BITS, np.int64)
    seen[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), seen


def feature_weights(texts: int, seen: np.ndarray, strength: float) -> np.ndarray:
    idf = np.log((texts + 1) / (seen + 1)) / max(math.log(texts + 1), 1e-9)
    return (1 + strength * np.clip(idf, 0, 1)).astype(np.float32)


def _band_rows(settings: NearSettings, idf: Broadcast[np.ndarray]):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node")
            for low, high, chunk in textbytes.chunks(batch.column("text")):
                rows, ids, weights = weighted(*shingles(chunk, settings.width), idf.value)
                if not len(rows):
                    continue
                at, samples = sketch(rows, ids, weights, settings.bands * settings.rows)
                samples = samples.reshape(len(at), settings.bands, settings.rows)
                keys = np.broadcast_to(np.arange(settings.bands, dtype=np.uint64),
                                       samples.shape[:2]).copy()
                for k in range(settings.rows):
                    keys = textbytes.mix(keys ^ samples[:, :, k])
                own = nodes.slice(low, high - low).take(pa.array(np.repeat(at, settings.bands)))
                yield pa.record_batch({"bucket": keys.reshape(-1).view(np.int64), "node": own})
    return build


def _shingle_lists(width: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, chunk in textbytes.chunks(batch.column("text")):
                rows, ids = shingles(chunk, width)
                at = np.searchsorted(rows, np.arange(chunk.rows + 1))
                packed = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch({"node": batch.column("node").slice(low, high - low),
                                       "ids": pa.array(packed, pa.binary())})
    return build


def _similarities(idf: Broadcast[np.ndarray]):
    def weigh(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(packed, np.uint64)
        _, ids, weights = weighted(np.zeros(len(ids), np.int64), ids, idf.value)
        return ids, weights.astype(np.float64)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[bytes, tuple] = (b"", weigh(b""))
        for batch in batches:
            sims = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column("ids_a"), batch.column("ids_b"), strict=True)):
                x, y = x.as_py(), y.as_py()
                if x != kept[0]:
                    kept = x, weigh(x)
                (a, wa), (b, wb) = kept[1], weigh(y)
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                same = a[at] == b
                common = np.minimum(wa[at[same]], wb[same]).sum()
                sims[i] = common / (wa.sum() + wb.sum() - common)
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "sim": sims})
    return build


def _summaries(idf: Broadcast[np.ndarray]):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SUMMARY_ROWS):
                part = batch.slice(at, _SUMMARY_ROWS)
                lists = [np.frombuffer(x, np.uint64) for x in part.column("ids").to_pylist()]
                rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                rows, ids, weights = weighted(rows, np.concatenate(lists), idf.value)
                yield summary(part.column("node"), rows, ids, weights.astype(np.float64))
    return build


def _marked(spark: SparkSession, docs: DataFrame, settings: NearSettings) -> DataFrame:
    """The rows of ``near_duplicates`` and, first, the node of their text."""
    stages = StageTables(spark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    keyed = rows.withColumn("node", F.unhex(F.md5("text")))
    # one copy for all steps; inside a function each step would send its own
    idf = spark.sparkContext.broadcast(feature_weights(
        *document_frequencies(rows, settings.width), settings.idf_strength))
    texts = keyed.filter("text is not null").select("node", "text")
    members = stages.get("members", lambda: texts.mapInArrow(
        _band_rows(settings, idf), "bucket long, node binary").distinct())
    shared = members.groupBy("bucket").count().filter("count > 1").select("bucket")
    members = stages.get("shared", lambda: members.join(shared, "bucket", "left_semi"))
    lists = stages.get("lists", lambda: texts.join(members.select("node").distinct(), "node", "left_semi")
                       .dropDuplicates(["node"]).mapInArrow(
                           _shingle_lists(settings.width), "node binary, ids binary"))

    def verify(pairs: DataFrame) -> DataFrame:
        right = lists.select(F.col("node").alias("b"), F.col("ids").alias("ids_b"))
        left = lists.select(F.col("node").alias("a"), F.col("ids").alias("ids_a"))
        return pairs.join(right, "b").join(left, "a").select(
            "a", "b", "ids_a", "ids_b").mapInArrow(
                _similarities(idf), "a binary, b binary, sim double")

    def summarise(nodes: DataFrame) -> DataFrame:
        return lists.join(nodes, "node", "left_semi").mapInArrow(_summaries(idf), SUMMARY)

    groups = bucket_links(stages, members, verify, settings.threshold, "near", summarise)
    placed = keyed.select("doc_id", "node").join(groups, "node", "left").withColumn(
        "class", F.coalesce("component", "node"))
    sizes = placed.groupBy("class").agg(F.min("doc_id").alias("class_id"),
                                        F.count("*").alias("class_size"))
    return placed.join(sizes, "class", "left").select(
        "node", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (F.col("class_id").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("stays"))


def near_duplicates(spark: SparkSession, docs: DataFrame,
                    settings: NearSettings = NearSettings()) -> DataFrame:
    """Per row: doc_id, class_id (smallest doc_id of its group), class_size, and whether it stays.

    One row of a group stays: that with the smallest doc_id (of repeated rows each is marked).
    """
    return _marked(spark, docs, settings).drop("node")


def representatives(spark: SparkSession, docs: DataFrame,
                    settings: NearSettings = NearSettings()) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group; rows without text.

    Groups without any id stay whole.
    """
    gone = _marked(spark, docs, settings).filter(~F.col("stays") & F.col("node").isNotNull()).select(
        F.col("doc_id").alias("gone_doc"), F.col("node").alias("gone_node")).distinct()
    node = F.unhex(F.md5(docs["text"].cast("string")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_doc"]) & (node == gone["gone_node"]),
                     "left_anti")
