"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

A document is its token ids and one end id; a null text is empty, so it has the end id alone. It
is cut into pieces of the sequence length, which are sequences of their own, and a rest. Rests
are dealt by document over bins of bounded expected size. Each bin gets as many sequences as its
tokens need; in order of descending length, a rest goes whole to the sequence of the lowest cost
(``linear * n + quadratic * n * n``, summed over the pieces) that has room. One that fits nowhere
fills the lowest-cost sequence with room, and what is left of it waits its turn as a shorter
piece. So all sequences of a bin are full but for less than one sequence of padding in total.

Rows that repeat are packed once each. Other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PackSettings:
    """``rests_per_bin`` bounds the mean number of documents of a bin, whatever the table's size."""

    length: int = 2048
    end_id: int = 1
    linear: float = 1.0
    quadratic: float = 1.0 / 2048
    rests_per_bin: int = 4096


def public_ranks() -> tuple[str, str]:
    """(rank file, split pattern) of the public 50k byte-level vocabulary byte_bpe_50k."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def public_vocabulary() -> tuple[str, str, tuple[tuple[str, int], ...]]:
    """``public_ranks`` and the added tokens of byte_bpe_50k.json, which texts may spell out."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    return *public_ranks(), tuple((t["content"], t["id"]) for t in added)


_encoders: dict[tuple, object] = {}


def encoder(ranks: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
    """A byte-level BPE encoder from a rank file, read once in a process.

    The strings of ``added`` tokens in a text become those tokens; without any, all text is plain.
    """
    import tiktoken

    key = ranks, pattern, added
    if key not in _encoders:
        with open(ranks, "rb") as file:
            table = {base64.b64decode(t): int(n) for t, n in map(bytes.split, file)}
        _encoders[key] = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=dict(added))
    return _encoders[key]


PIECE = ("doc_id long, known boolean, start long, length long, ids_crc32 long, doc_tokens long, "
         "sequence_id long, offset long")


def _pieces(ranks: str, pattern: str, added: tuple[tuple[str, int], ...], settings: PackSettings):
    """doc_id, start, doc_tokens, n, crc32 and (of rests only) the ids of each piece."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern, added)
        end = np.array([settings.end_id], np.uint32)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in (
                "doc_id", "known", "bin", "start", "doc_tokens", "length", "ids_crc32", "ids")}
            columns = (batch.column(k) for k in ("doc_id", "known", "bin", "text"))
            for doc, known, bin_, text in zip(*columns, strict=True):
                ids = np.concatenate([
                    encode.encode_to_numpy(text.as_py() or "", allowed_special="all"), end])
                for start in range(0, len(ids), settings.length):
                    piece = ids[start:start + settings.length].astype("<u4").tobytes()
                    whole = len(piece) == 4 * settings.length
                    row = (doc.as_py(), known.as_py(), bin_.as_py(), start, len(ids), len(piece) // 4,
                           zlib.crc32(piece), b"" if whole else piece)
                    for values, value in zip(out.values(), row, strict=True):
                        values.append(value)
            kinds = {"ids": pa.binary(), "known": pa.bool_()}
            yield pa.record_batch({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})
    return build


def assign(lengths: np.ndarray, settings: PackSettings) -> list[tuple[int, int, int, int]]:
    """(rest, its first token, tokens, sequence) of each piece, in order of placement."""
    n_sequences = -(-int(lengths.sum()) // settings.length)
    room = np.full(n_sequences, settings.length, np.int64)
    cost = np.zeros(n_sequences)
    waiting = [(-int(n), i, 0) for i, n in enumerate(lengths)]
    heapq.heapify(waiting)
    placed = []
    while waiting:
        n, i, start = heapq.heappop(waiting)
        n = -n
        open_ = np.where(room >= n, cost, np.inf)
        at = int(open_.argmin())
        if open_[at] == np.inf:
            at = int(np.where(room > 0, cost, np.inf).argmin())
            heapq.heappush(waiting, (int(room[at]) - n, i, start + int(room[at])))
            n = int(room[at])
        placed.append((i, start, n, at))
        room[at] -= n
        cost[at] += settings.linear * n + settings.quadratic * n * n
    return placed


def _pack(settings: PackSettings):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        bin_ = int(rows["bin"].iloc[0])
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        whole = rows["length"].to_numpy() == settings.length
        full, rests = rows[whole], rows[~whole].reset_index(drop=True)
        out = [full.assign(sequence_id=np.arange(len(full)), offset=0)]
        used: dict[int, int] = {}
        pieces = []
        for i, first, n, sequence in assign(rests["length"].to_numpy(), settings):
            ids = rests["ids"].iat[i][4 * first:4 * (first + n)]
            pieces.append((i, first, n, zlib.crc32(ids), len(full) + sequence, used.get(sequence, 0)))
            used[sequence] = used.get(sequence, 0) + n
        at, first, n, crc, sequence, offset = (
            np.array(x, np.int64) for x in (zip(*pieces, strict=True) if pieces else [()] * 6))
        taken = rests.iloc[at]
        out.append(taken.assign(start=taken["start"].to_numpy() + first, length=n, ids_crc32=crc,
                                sequence_id=sequence, offset=offset))
        packed = pd.concat(out, ignore_index=True)
        packed["sequence_id"] += bin_ << 40
        return packed[[c.split()[0] for c in PIECE.split(", ")]]
    return pack


def packed(spark: SparkSession, docs: DataFrame, ranks: str, pattern: str,
           added: tuple[tuple[str, int], ...] = (),
           settings: PackSettings = PackSettings()) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Rows are dealt over bins by id, text and a row number within the partition they are read in,
    so rows that share all columns spread as well.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
                       F.col("doc_id").isNotNull().alias("known"),
                       F.col("text").cast("string").alias("text"))
    bins = max(1, -(-rows.count() // settings.rests_per_bin))
    salt = F.monotonically_increasing_id()
    spread = F.pmod(F.xxhash64("doc_id", F.crc32("text"), salt), F.lit(bins))
    return rows.withColumn("bin", spread).mapInArrow(
        _pieces(ranks, pattern, added, settings),
        "doc_id long, known boolean, bin long, start long, doc_tokens long, length long, ids_crc32 long, ids binary",
    ).groupBy("bin").applyInPandas(_pack(settings), PIECE).withColumn(
        "doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")
