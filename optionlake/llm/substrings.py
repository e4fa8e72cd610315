"""Substring dedup by relative Lempel-Ziv parsing of each document against all earlier text.

The reference is the whole table in the order (doc_id, start). Its index holds windows of ``width``
words by fingerprint, in as many blocks as the shuffle has partitions, so each document is looked
up in every block at once; a block is sorted, and streams past each window's first occurrence. Greedy parsing joins consecutive windows which continue the same
earlier occurrence to one factor; a factor has ``width`` words or more and is a duplicate span.
Factors are checked at their boundaries: a window that spans two factors is looked up by itself.

Anchors keep the index small. The anchor of a window is the smallest fingerprint of ``seed``
consecutive words in it, so equal windows have equal anchors, and one position serves many windows.
Windows whose anchor occurs once anywhere cannot repeat. The anchors that repeat are held in a
bitmap of fixed size; one that fills up lets more windows through, but never loses one.

Null texts have no words; a null doc_id comes after all others. Rows that share doc_id and text
are one occurrence, so neither is earlier. Rows that share a doc_id only are ordered by checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from optionlake.llm import textbytes

WIDTH = 20
SEED = 8
FILTER_BITS = 27
_LAST = (1 << 63) - 1


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def _anchored(chunk: textbytes.Chunk, words: np.ndarray, width: int, seed: int):
    """First word and text of every window, fingerprints of all seeds, and each window's anchor."""
    starts, rows = chunk.window_starts(width)
    if not len(starts):
        return starts, rows, np.empty(0, np.uint64), np.empty(0, np.uint64)
    every = np.arange(len(words) - seed + 1)
    seeds = textbytes.Rolling(words, 1).spans(every, every + seed)
    return starts, rows, seeds, _sliding_least(seeds, width - seed + 1)[starts]


def _anchor_rows(width: int, seed: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, chunk in textbytes.chunks(batch.column("text")):
                starts, _, seeds, anchors = _anchored(chunk, chunk.word_hashes(), width, seed)
                chosen = np.zeros(len(seeds), bool)
                for ahead in range(width - seed + 1):
                    at = starts + ahead
                    chosen[at[seeds[at] == anchors]] = True
                yield pa.record_batch({"anchor": seeds[chosen].view(np.int64)})
    return build


def repeated_anchors(docs: DataFrame, width: int, seed: int, bits: int) -> np.ndarray:
    """A bitmap of 2**bits entries: those of the anchors which occur at two places or more."""
    entry = F.shiftrightunsigned("anchor", 64 - bits)
    words = (docs.select("text").mapInArrow(_anchor_rows(width, seed), "anchor long")
             .groupBy("anchor").count().filter("count > 1").select(entry.alias("entry"))
             .groupBy(F.shiftright("entry", 6).alias("at"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(entry & 63 as int)))").alias("word")))
    table = words.toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[table["at"].to_numpy()] = table["word"].to_numpy().view(np.uint64)
    return bitmap


def _window_rows(width: int, seed: int, bits: int, bitmap: np.ndarray):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc").to_numpy(), batch.column("key").to_numpy()
            for low, _, chunk in textbytes.chunks(batch.column("text")):
                words = chunk.word_hashes()
                starts, rows, _, anchors = _anchored(chunk, words, width, seed)
                entries = (anchors >> np.uint64(64 - bits)).astype(np.int64)
                hit = (bitmap[entries >> 6] >> (entries & 63).astype(np.uint64) & np.uint64(1)) > 0
                starts, rows = starts[hit], rows[hit]
                ends = starts + width
                windows = textbytes.Rolling(words, 1).spans(starts, ends)
                yield pa.record_batch({
                    "window": windows.view(np.int64), "doc": ids[low + rows],
                    "place": keys[low + rows] << 32 | starts - chunk.word_bounds[:-1][rows]})
    return build


def repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED,
            bits: int = FILTER_BITS) -> DataFrame:
    """Per text with duplicates: doc, key, and (start, ref_doc, ref_start) of each later window.

    ``docs`` has doc (long), key (checksum of the text) and text. The first occurrence of a window
    is its smallest (doc, key, start); it is the reference of all later ones. Repeated rows give
    the same windows, which count once.
    """
    bitmap = repeated_anchors(docs, width, seed, bits)
    windows = docs.mapInArrow(_window_rows(width, seed, bits, bitmap),
                              "window long, doc long, place long")
    earlier = W.partitionBy("window").orderBy("doc", "place").rowsBetween(W.unboundedPreceding, 0)
    later = windows.select("doc", "place", F.first("doc").over(earlier).alias("ref_doc"),
                           F.first("place").over(earlier).alias("ref_place")).filter(
                               "doc > ref_doc or place > ref_place")
    start, low = "cast(place & 4294967295 as int)", "cast(ref_place & 4294967295 as int)"
    return later.groupBy("doc", F.shiftright("place", 32).alias("key")).agg(F.sort_array(
        F.collect_set(F.struct(F.expr(start).alias("start"), "ref_doc",
                                F.expr(low).alias("ref_start")))).alias("found"))


FACTOR = "array<struct<start:int,length:int,ref_doc_id:bigint,ref_start:int>>"


def _parse(starts: np.ndarray, refs: np.ndarray, ref_starts: np.ndarray, width: int) -> list[dict]:
    """Joins windows that continue one earlier occurrence to factors."""
    if not len(starts):
        return []
    new = np.ones(len(starts), bool)
    new[1:] = ((np.diff(starts) != 1) | (np.diff(ref_starts) != 1) | (refs[1:] != refs[:-1]))
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    return [{"start": int(starts[i]), "length": int(n) + width - 1, "ref_doc_id": int(refs[i]),
             "ref_start": int(ref_starts[i])} for i, n in zip(at, count, strict=True)]


def _kept(width: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("found")
            for low, high, chunk in textbytes.chunks(batch.column("text")):
                raw, out = chunk.data.tobytes(), {"n_words": [], "n_removed": [], "kept": [],
                                                  "factors": []}
                for i in range(chunk.rows):
                    a, b = chunk.word_bounds[i], chunk.word_bounds[i + 1]
                    keep = np.ones(b - a, bool)
                    found, factors = lists[low + i].values, []
                    if found is not None and len(found):
                        starts, refs, ref_starts = (found.field(k).to_numpy() for k in range(3))
                        factors = _parse(starts, refs, ref_starts, width)
                        for f in factors:
                            keep[f["start"]:f["start"] + f["length"]] = False
                    at = a + np.flatnonzero(keep)
                    words = zip(chunk.starts[at].tolist(), chunk.ends[at].tolist(), strict=True)
                    out["n_words"].append(b - a)
                    out["n_removed"].append(int(b - a - len(at)))
                    out["kept"].append(b" ".join([raw[s:e] for s, e in words]).decode())
                    out["factors"].append(factors)
                ids = batch.column("doc_id").slice(low, high - low)
                yield pa.record_batch({
                    "doc_id": ids, "n_words": pa.array(out["n_words"], pa.int64()),
                    "n_removed": pa.array(out["n_removed"], pa.int64()),
                    "kept_text": pa.array(out["kept"], pa.string()),
                    "factors": pa.array(out["factors"], pa.list_(pa.struct([
                        ("start", pa.int32()), ("length", pa.int32()), ("ref_doc_id", pa.int64()),
                        ("ref_start", pa.int32())])))})
    return build


def deduplicated(spark: SparkSession, docs: DataFrame, width: int = WIDTH,
                 seed: int = SEED) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (words joined by one space) and factors."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"),
                       F.shiftright(F.crc32("text"), 1).alias("key"))
    found = repeats(rows.select("doc", "key", "text"), width, seed)
    return rows.join(found, ["doc", "key"], "left").select("doc_id", "text", "found").mapInArrow(
        _kept(width), f"doc_id long, n_words long, n_removed long, kept_text string, factors {FACTOR}")
