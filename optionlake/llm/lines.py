"""Fuzzy line dedup by MinHash.

The shingles of a line are all its character ``gram``-grams (a line shorter than that is one gram).
Signatures are minima of their hashes, made once for each distinct line. Lines that agree in a band
of signatures are compared by the exact Jaccard similarity of their whole gram sets. A distributed
union-find turns the links into components; of each component, copies included, the first line in
the order (doc_id, line number) stays. Signatures and similarities are NumPy on Arrow batches, in
chunks of bounded size; a distinct line is known by its MD5.

Lines are parts between newlines. Blank ones always stay. Null texts stay null and have no lines.
Rows that share doc_id and text are one document: they lose and keep the same lines. Nulls in
doc_id come first. Other columns are carried by ``clean_lines`` and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from optionlake.llm import textbytes
from optionlake.llm.grouping import SUMMARY, bucket_links, summary
from optionlake.sources.stages import StageTables

_ROW_BITS = np.uint64(48)
#: Bytes of the pairs whose lines are held together; a longer pair is held alone.
_PAIR_BYTES = 1 << 21


@dataclass(frozen=True)
class LineSettings:
    gram: int = 5
    bands: int = 15
    rows: int = 5
    threshold: float = 0.8


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, at, line) of each line that is not blank."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"),
                       F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.filter("line rlike '[^ \\t-\\r]'")


def _node():
    return F.unhex(F.md5("line")).alias("node")


def grams(chunk: textbytes.Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all character grams of a chunk of lines, and where each line's begin."""
    starts = np.flatnonzero(chunk.data & 0xC0 != 0x80)
    at = np.searchsorted(starts, chunk.bounds)
    chars = np.diff(at)
    counts = np.where(chars > 0, np.maximum(chars - (width - 1), 1), 0)
    begin = np.concatenate([[0], np.cumsum(counts)])
    rolling = textbytes.Rolling(chunk.data + np.uint16(1))
    edges = np.append(starts, len(chunk.data))
    # the grams at all characters, less those that run into the next line
    inside = np.ones(max(len(edges) - width, 0), bool)
    for k in range(1, width):
        ends = at[1:] - k
        inside[ends[(ends >= 0) & (ends < len(inside))]] = False
    plain = len(starts) == len(chunk.data)
    ids = (rolling.windows(width) if plain else rolling.spans(edges[:-width], edges[width:]))[inside]
    short = np.flatnonzero((chars > 0) & (chars < width))
    if len(short):
        long = np.ones(begin[-1], bool)
        long[begin[:-1][short]] = False
        full, ids = ids, np.empty(begin[-1], np.uint64)
        ids[long] = full
        ids[~long] = rolling.spans(edges[at[:-1][short]], edges[at[1:][short]])
    return ids, begin


def _band_rows(settings: LineSettings):
    """(bucket, key) rows: the band keys of each line, copies in a batch once."""
    count = settings.bands * settings.rows
    seeds = textbytes.mix(np.arange(1, count + 1, dtype=np.uint64))
    factors = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    shifts = seeds.astype(np.uint32)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys_in = batch.column("key").to_numpy()
            batch = batch.take(pa.array(np.sort(np.unique(keys_in, return_index=True)[1])))
            for low, high, chunk in textbytes.chunks(batch.column("line")):
                ids, begin = grams(chunk, settings.gram)
                hashes = (ids >> np.uint64(32)).astype(np.uint32)
                work = np.empty_like(hashes)
                samples = np.empty((chunk.rows, count), np.uint64)
                for k in range(count):
                    np.multiply(hashes, factors[k], out=work)
                    np.add(work, shifts[k], out=work)
                    samples[:, k] = np.minimum.reduceat(work, begin[:-1])
                samples = samples.reshape(chunk.rows, settings.bands, settings.rows)
                keys = np.broadcast_to(np.arange(settings.bands, dtype=np.uint64),
                                       samples.shape[:2]).copy()
                for k in range(settings.rows):
                    keys = textbytes.mix(keys ^ samples[:, :, k])
                own = np.repeat(batch.column("key").to_numpy()[low:high], settings.bands)
                yield pa.record_batch({"bucket": keys.reshape(-1).view(np.int64), "key": own})
    return build


def _gram_sets(chunk: textbytes.Chunk, width: int) -> np.ndarray:
    """Sorted distinct (row, 48-bit gram) keys of a chunk."""
    ids, begin = grams(chunk, width)
    rows = np.repeat(np.arange(chunk.rows, dtype=np.uint64), np.diff(begin))
    return textbytes.distinct(rows << _ROW_BITS | ids >> np.uint64(16))


def _sets_by_row(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 48-bit grams of each text."""
    found = []
    for _, _, chunk in textbytes.chunks(texts):
        keys = _gram_sets(chunk, width)
        at = np.searchsorted(keys, np.arange(chunk.rows + 1, dtype=np.uint64) << _ROW_BITS)
        ids = keys & np.uint64((1 << 48) - 1)
        found += [ids[low:high] for low, high in zip(at[:-1], at[1:], strict=True)]
    return found


def _similarities(width: int):
    """(a, b, sim) from pairs with both lines; a line that returns in a run is cut into grams once."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(np.diff(textbytes.buffers(batch.column(f"line_{x}"))[1]) for x in "ab")
            run = np.cumsum(sizes) // _PAIR_BYTES
            cuts = np.flatnonzero(np.diff(run, prepend=-1, append=-1))
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(start, stop - start)
                texts = pa.concat_arrays([part.column("line_a"), part.column("line_b")]).dictionary_encode()
                sets = _sets_by_row(texts.dictionary, width)
                code = texts.indices.to_numpy()
                sims = np.zeros(part.num_rows)
                for i, (x, y) in enumerate(zip(code[:len(sims)], code[len(sims):], strict=True)):
                    x, y = sets[x], sets[y]
                    n = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
                    sims[i] = n / (len(x) + len(y) - n)
                yield pa.record_batch({"a": part.column("a"), "b": part.column("b"), "sim": sims})
    return build


def _summaries(width: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, chunk in textbytes.chunks(batch.column("line")):
                keys = _gram_sets(chunk, width)
                rows = (keys >> _ROW_BITS).astype(np.int64)
                yield summary(batch.column("node").slice(low, high - low), rows,
                              keys & np.uint64((1 << 48) - 1), np.ones(len(keys)))
    return build


def line_groups(spark: SparkSession, docs: DataFrame, settings: LineSettings,
                stages: StageTables) -> DataFrame:
    """(node, component) of the lines that are similar to another line."""
    # short keys find the candidates in one shuffle by bucket; only lines that meet another are kept
    found = _lines(docs).select(F.xxhash64("line").alias("key"), "line")
    keyed = found.mapInArrow(_band_rows(settings), "bucket long, key long").repartition("bucket")
    every = W.partitionBy("bucket")
    met = stages.get("met", lambda: keyed.withColumns(
        {"low": F.min("key").over(every), "high": F.max("key").over(every)}).filter(
            "low < high").select("bucket", "key").distinct())
    # from here on a line is known by its MD5; lines that share a key are told apart again
    texts = stages.get("texts", lambda: found.join(
        met.select("key").distinct().hint("shuffle_hash"), "key", "left_semi").distinct().select(
            "key", _node(), "line"))
    members = stages.get("members", lambda: met.join(texts.select("key", "node"), "key").select(
        "bucket", "node"))

    def verify(pairs: DataFrame) -> DataFrame:
        right = texts.select(F.col("node").alias("b"), F.col("line").alias("line_b"))
        left = texts.select(F.col("node").alias("a"), F.col("line").alias("line_a"))
        return pairs.join(right, "b").join(left, "a").select("a", "b", "line_a", "line_b").mapInArrow(
            _similarities(settings.gram), "a binary, b binary, sim double")

    def summarise(nodes: DataFrame) -> DataFrame:
        return texts.join(nodes, "node", "left_semi").mapInArrow(_summaries(settings.gram), SUMMARY)

    return bucket_links(stages, members, verify, settings.threshold, "lines", summarise)


def removed_lines(spark: SparkSession, docs: DataFrame,
                  settings: LineSettings = LineSettings()) -> DataFrame:
    """(doc_id, text_key, removed): the numbers of the lines that go, of documents that lose any."""
    stages = StageTables(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    groups = line_groups(spark, rows, settings, stages)
    places = stages.get("places", lambda: _lines(rows).select(_node(), "doc_id", "text_key", "at"))
    # only lines with a copy or a group can go; a repeated row makes copies too, dropped below
    copied = places.groupBy("node").count().filter("count > 1").select("node")
    wanted = copied.join(groups, "node", "full").select(
        "node", F.coalesce("component", "node").alias("class"))
    found = stages.get("found", lambda: places.join(wanted, "node").select(
        "class", F.struct("doc_id", "text_key", "at").alias("place")))
    keepers = found.groupBy("class").agg(F.min("place").alias("keeper"))
    return found.join(keepers, "class").filter("not (place <=> keeper)").groupBy(
        "place.doc_id", "place.text_key").agg(F.sort_array(F.collect_set("place.at")).alias("removed"))


def _marks():
    """True for each removed line, up to the last of them."""
    gap = "array_repeat(false, r - coalesce(get(removed, i - 1), -1) - 1)"
    return F.expr(f"flatten(transform(removed, (r, i) -> concat({gap}, array(true))))")


def clean_lines(spark: SparkSession, docs: DataFrame,
                settings: LineSettings = LineSettings()) -> DataFrame:
    """The rows of ``docs``, all columns, without the removed lines; last, their numbers."""
    gone = removed_lines(spark, docs, settings).select(
        F.col("doc_id").alias("gone_doc"), F.col("text_key").alias("gone_key"), "removed", _marks().alias("marks"))
    left, name = docs, "removed_lines"
    while name in docs.columns:
        name = "_" + name
    joined = left.alias("l").join(gone.alias("g"), F.expr(
        "cast(l.doc_id as bigint) <=> g.gone_doc and xxhash64(l.text) = g.gone_key"), "left")
    both = F.arrays_zip(F.split("l.text", "\n").alias("line"), F.col("g.marks").alias("mark"))
    kept = F.array_join(F.transform(F.filter(
        both, lambda x: ~F.coalesce(x["mark"], F.lit(False))), lambda x: x["line"]), "\n")
    text = F.when(F.col("g.removed").isNull(), F.col("l.text")).otherwise(kept)
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"l.`{c}`")
                           for c in docs.columns),
                         F.coalesce("g.removed", F.array().cast("array<int>")).alias(name))
