"""Text statistics for rules and classifiers: one pass over the bytes of each whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from optionlake.llm import textbytes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_marks", "n_bars", "n_ends")
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_MARKS = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_ENDS = np.isin(np.arange(256), np.frombuffer(b".,;:", np.uint8))
REPEAT_WIDTH = 8


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each row; 48 bits of a key are compared, inside one text only."""
    joint = np.unique(rows.astype(np.uint64) << np.uint64(48) | keys >> np.uint64(16))
    return np.bincount((joint >> np.uint64(48)).astype(np.int64), minlength=n)


def measure(chunk: textbytes.Chunk) -> dict[str, np.ndarray]:
    """The COUNTS of each text of a chunk."""
    data, n = chunk.data, chunk.rows
    rows, words = chunk.row_of_word, chunk.word_hashes()

    starts, of = chunk.window_starts(REPEAT_WIDTH)
    windows = textbytes.Rolling(words, 1).spans(starts, starts + REPEAT_WIDTH)
    edges = np.zeros(len(words) + 1, np.int64)
    twice = starts[textbytes.repeated(windows, of)]
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + REPEAT_WIDTH, -1)
    covered = np.cumsum(edges[:-1]) > 0

    breaks = np.flatnonzero(data == 10)
    heads = np.concatenate([chunk.bounds[:-1], breaks + 1])
    tails = np.concatenate([breaks, chunk.bounds[1:]])
    heads.sort()
    tails.sort()
    line_rows = np.searchsorted(chunk.bounds[1:], heads, side="right")
    # an empty text has one empty line, which no later row may claim
    filled = np.searchsorted(chunk.starts, tails) > np.searchsorted(chunk.starts, heads)
    heads, tails, filled_rows = heads[filled], tails[filled], line_rows[filled]
    lines = textbytes.Rolling(data + np.uint16(1)).spans(heads, tails)
    full = np.bincount(filled_rows, minlength=n)

    text = data < 128
    return {
        "n_words": chunk.n_words,
        "word_chars": chunk.per_row(chunk.word & ((data & 0xC0) != 0x80)),
        "n_symbols": chunk.per_row(_SYMBOLS[data]),
        "n_dup_lines": full - _distinct(lines, filled_rows, n),
        "n_repeat_words": chunk.per_row(covered, chunk.word_bounds),
        "n_lines": full,
        "n_distinct_words": _distinct(words, rows, n),
        "n_upper": chunk.per_row(text & (data >= 65) & (data <= 90)),
        "n_lower": chunk.per_row(text & (data >= 97) & (data <= 122)),
        "n_digits": chunk.per_row((data >= 48) & (data <= 57)),
        "n_marks": chunk.per_row(_MARKS[data]),
        "n_bars": chunk.per_row(data == ord("|")),
        "n_ends": chunk.per_row(_ENDS[data]),
    }


def with_measures(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with the COUNTS of ``text`` (null: empty) appended under a prefix."""
    clash = {prefix + c for c in COUNTS} & set(docs.columns)
    if clash:
        raise ValueError(f"columns already present: {sorted(clash)}")
    schema = T.StructType([*docs.schema.fields, *(
        T.StructField(prefix + c, T.LongType()) for c in COUNTS)])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, chunk in textbytes.chunks(batch.column("text")):
                found = measure(chunk)
                own = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, *(pa.array(found[c].astype(np.int64)) for c in COUNTS)],
                    names=[*own.schema.names, *(prefix + c for c in COUNTS)])

    return docs.mapInArrow(build, schema)
