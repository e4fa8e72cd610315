"""Words, lines and rolling fingerprints of Arrow text columns, computed on their UTF-8 bytes.

Texts are taken in chunks of about ``CHUNK_BYTES`` (a longer text is a chunk of its own), so the
working memory of a task does not depend on the size of its batches. A word is a run of bytes
other than space and 0x09-0x0D; words never cross two texts. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(size: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a family's multiplier and of its inverse, modulo 2**64."""
    up, down = _powers.get(family, (np.empty(0, np.uint64),) * 2)
    if len(up) < size:
        base = _MULTIPLIERS[family]
        steps = np.full(max(size, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        back = np.full(len(steps), pow(base, -1, 1 << 64), np.uint64)
        back[0] = 1
        up, down = np.cumprod(steps, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        if size <= CHUNK_BYTES + 1:
            _powers[family] = up, down
    return up, down


class Rolling:
    """Fingerprints of any span of a sequence from one pass over it."""

    def __init__(self, values: np.ndarray, family: int = 0) -> None:
        n = len(values)
        up, self._down = _tables(n + 1, family)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * up[:n], out=self._sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed fingerprints of [start, end); the length takes part."""
        found = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(found + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def windows(self, width: int) -> np.ndarray:
        """``spans`` of each run of ``width`` values."""
        n = max(len(self._sums) - width, 0)
        found = (self._sums[width:] - self._sums[:n]) * self._down[:n]
        return mix(found + np.uint64(width * 0xA0761D6478BD642F % (1 << 64)))


class Chunk:
    """Consecutive texts: their bytes, words, and where each text's words begin."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.data, self.bounds, self.rows = data, bounds, len(bounds) - 1
        word = ~SPACE[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = bounds[1:] > bounds[:-1]
        heads, tails = bounds[:-1][full], bounds[1:][full] - 1
        first[heads] = word[heads]
        last[tails] = word[tails]
        self.word = word
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.word_bounds = np.searchsorted(self.starts, bounds)
        self.n_words = np.diff(self.word_bounds)

    @property
    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.n_words)

    def word_hashes(self, family: int = 0, fold_case: bool = False) -> np.ndarray:
        """A 64-bit fingerprint of each word; ``fold_case`` lowers A-Z first."""
        data = self.data
        if fold_case:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        return Rolling(data + np.uint16(1), family).spans(self.starts, self.ends)

    def window_starts(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and text of each window of ``width`` words inside one text."""
        counts = np.maximum(self.n_words - (width - 1), 0)
        rows = np.repeat(np.arange(self.rows), counts)
        ahead = np.cumsum(counts) - counts
        return np.arange(len(rows)) - ahead[rows] + self.word_bounds[:-1][rows], rows

    def per_row(self, values: np.ndarray, bounds: np.ndarray | None = None) -> np.ndarray:
        """Sums of byte values (or of word values, with word bounds) by text."""
        sums = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=sums[1:])
        return np.diff(sums[self.bounds if bounds is None else bounds])


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), at


def chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, Chunk]]:
    """(first row, end row, chunk) over a column of texts."""
    if len(texts) == 0:
        return
    data, at = buffers(texts)
    low, n = 0, len(at) - 1
    while low < n:
        high = int(np.searchsorted(at, at[low] + CHUNK_BYTES, side="right")) - 1
        high = min(max(high, low + 1), n, low + 0xFFFF)
        yield low, high, Chunk(data[at[low]:at[high]], at[low:high + 1] - at[low])
        low = high


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys; sorts in place. ``np.unique`` is many times slower on long integers."""
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


def repeated(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Marks the entries whose (row, key) occurs twice or more."""
    order = np.lexsort((keys, rows))
    same = (keys[order][1:] == keys[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice
