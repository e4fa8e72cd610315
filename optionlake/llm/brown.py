"""Brown class-based n-grams: exchange clustering, class transitions and word emissions.

Tokens are the words of a text with A-Z lowered, then one end token. Word counts cover all
training documents. Every known word has a class that follows from its own bigrams:

- The seed units are the ``frequent`` most frequent words and, for all other words, their shapes
  (last two bytes and length). Their bigrams fit one dense table; units move one at a time to the
  class that raises the likelihood of the class bigrams most, until none moves (``sweeps`` bounds
  that if set). Frequent words keep these classes.
- All other known words are then placed in Spark, ``rounds`` times: the classes before and after a
  word are counted over all training documents, and it goes to the class that gains most to first
  order, against the class-by-class table. In the next round, words with ``least`` occurrences or
  more count as neighbours with the class they got, rarer ones with that of their shape. Moves of
  a round are made at once; the rounds are few and do not go on until no word moves.

An unknown word has the class of its shape.

log10 P(text) is the sum over tokens of log10 P(class | previous class) + log10 P(word | class),
with P(c'|c) = (n(c,c') + a) / (n(c) + a C) and P(w|c) = (n(w) + 1) / (n(c) + v(c) + 1): v(c) is
the number of known words of the class, and the last 1 stands for its unknown words. A text is
preceded by an end token.

Counts of the ``local`` most frequent words (a bounded table) go to the tasks; rarer words are
joined by their 64-bit fingerprints, so no join key is frequent. Null texts are empty: one end
token. A null doc_id is never held out. Repeated rows are scored each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optionlake.llm import textbytes
from optionlake.sources.stages import StageTables

END = np.uint64(1)


@dataclass(frozen=True)
class BrownSettings:
    classes: int = 48
    frequent: int = 1024
    shapes: int = 256
    local: int = 1 << 18
    sweeps: int | None = None
    least: int = 3
    rounds: int = 2
    smoothing: float = 0.1


def tokens(chunk: textbytes.Chunk, shapes: int):
    """(fingerprint, shape, row) of each token, every text followed by its end token."""
    words = chunk.word_hashes(fold_case=True)
    data = chunk.data.astype(np.uint64)
    length = np.minimum(chunk.ends - chunk.starts, 15).astype(np.uint64)
    last = data[chunk.ends - 1] | np.uint64(32)
    before = np.where(length > 1, data[np.maximum(chunk.ends - 2, 0)] | np.uint64(32), 0)
    look = textbytes.mix(last.astype(np.uint64) << np.uint64(16) | before.astype(np.uint64) << np.uint64(8) | length)
    ends = chunk.word_bounds[1:]
    hashes = np.insert(words, ends, END)
    shape = np.insert((look % np.uint64(shapes)).astype(np.int64), ends, shapes)
    return hashes, shape, np.repeat(np.arange(chunk.rows), chunk.n_words + 1)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys`` and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _word_counts(shapes: int, held: int = 1 << 21):
    def merge(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, shape, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, at, back = np.unique(keys, return_index=True, return_inverse=True)
        return keys, shape[at], np.bincount(back, weights=n).astype(np.int64)

    def rows(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        if parts:
            keys, shape, n = merge(parts)
            for i in range(0, len(keys), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.record_batch({"word": keys[part].view(np.int64), "shape": shape[part],
                                       "n": n[part]})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        size = 0
        for batch in batches:
            for _, _, chunk in textbytes.chunks(batch.column("text")):
                hashes, shape, _ = tokens(chunk, shapes)
                keys, at, n = np.unique(hashes, return_index=True, return_counts=True)
                parts.append((keys, shape[at], n))
                size += len(keys)
                if size > held:
                    parts = [merge(parts)]
                    size = len(parts[0][0])
                    if size > held // 2:
                        yield from rows(parts)
                        parts, size = [], 0
        yield from rows(parts)
    return build


class Units:
    """Which unit a token is: a frequent word, the shape of another word, or the end token."""

    def __init__(self, words: np.ndarray, shapes: int) -> None:
        self.words, self.shapes = words, shapes
        self.end = len(words) + shapes
        self.size = self.end + 1

    def of(self, hashes: np.ndarray, shape: np.ndarray) -> np.ndarray:
        at, found = _lookup(self.words, hashes)
        return np.where(found, at, len(self.words) + shape)


def _bigrams(units: Units):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(units.size * units.size, np.int64)
        for batch in batches:
            for _, _, chunk in textbytes.chunks(batch.column("text")):
                hashes, shape, _ = tokens(chunk, units.shapes)
                now = units.of(hashes, shape)
                # the token before a text's first one is the end token of the text before it
                before = np.concatenate([[units.end], now[:-1]])
                seen += np.bincount(before * units.size + now, minlength=len(seen))
        at = np.flatnonzero(seen)
        for i in range(0, len(at), 1 << 16):
            yield pa.record_batch({"pair": at[i:i + (1 << 16)], "n": seen[at[i:i + (1 << 16)]]})
    return build


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int | None) -> np.ndarray:
    """Class of each unit; the last unit (the end token) is a class of its own.

    Starts from classes dealt by descending frequency; each sweep visits the units in that order.
    """
    size = len(bigrams)
    order = np.argsort(-bigrams.sum(0), kind="stable")
    order = order[order != size - 1]
    of = np.empty(size, np.int64)
    of[order] = np.arange(size - 1) % (classes - 1)
    of[-1] = classes - 1
    onehot = np.zeros((size, classes))
    onehot[np.arange(size), of] = 1
    right, left = bigrams @ onehot, bigrams.T @ onehot  # counts after and before, by class
    table = onehot.T @ right
    for _ in itertools.count() if sweeps is None else range(sweeps):
        moved = 0
        for u in order.tolist():
            own, loop = of[u], bigrams[u, u]
            after, before = right[u].copy(), left[u].copy()
            after[own] -= loop
            before[own] -= loop
            out, into = after.sum() + loop, before.sum() + loop
            if out + into == 0:
                continue
            table[own] -= after
            table[:, own] -= before
            table[own, own] -= loop
            rows, cols, diag = table.sum(1), table.sum(0), np.diag(table)
            gain = (_xlogx(table + after) - _xlogx(table)).sum(1) - (
                _xlogx(diag + after) - _xlogx(diag))
            gain += (_xlogx(table.T + before) - _xlogx(table.T)).sum(1) - (
                _xlogx(diag + before) - _xlogx(diag))
            gain += _xlogx(diag + after + before + loop) - _xlogx(diag)
            gain -= _xlogx(rows + out) - _xlogx(rows) + _xlogx(cols + into) - _xlogx(cols)
            gain[-1] = -np.inf
            new = int(gain.argmax())
            new = new if gain[new] > gain[own] + 1e-9 else own
            table[new] += after
            table[:, new] += before
            table[new, new] += loop
            if new != own:
                of[u] = new
                moved += 1
                for counts, line in ((right, bigrams[:, u]), (left, bigrams[u])):
                    counts[:, own] -= line
                    counts[:, new] += line
        if not moved:
            break
    return of


class Classes:
    """Class of a token: that of its word, if listed, or else of its shape."""

    def __init__(self, units: Units, of: np.ndarray, words: np.ndarray, classes: np.ndarray) -> None:
        order = np.argsort(words)
        self.shapes, self.shape_classes = units.shapes, of[len(units.words):]
        self.words, self.classes = words[order], classes[order]

    def of(self, hashes: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes, and whether the word is listed."""
        at, found = _lookup(self.words, hashes)
        own = self.classes[at] if len(self.words) else 0
        return np.where(found, own, self.shape_classes[shape]), found


def _contexts(known: Classes, fixed: np.ndarray, count: int, joint: bool = False):
    """(word, slot, n) of words not ``fixed`` (sorted): the class before (slot < count) or after.

    Joint slots stand for both neighbours (before * count + after), so an occurrence is one row.
    Rows of the slot that follows hold the class pairs of all tokens instead, by number of the pair.
    """
    slots = count * count if joint else 2 * count

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(count * count, np.int64)
        for batch in batches:
            for _, _, chunk in textbytes.chunks(batch.column("text")):
                hashes, shape, _ = tokens(chunk, known.shapes)
                of, _ = known.of(hashes, shape)
                before = np.concatenate([[count - 1], of[:-1]])
                pairs += np.bincount(before * count + of, minlength=len(pairs))
                # a word is never the last token of a text
                inner = np.flatnonzero(~_lookup(fixed, hashes)[1] & (hashes != END))
                words, at = np.unique(hashes[inner], return_inverse=True)
                if joint:
                    keys = at * slots + before[inner] * count + of[inner + 1]
                else:
                    keys = np.concatenate([at * slots + before[inner],
                                           at * slots + count + of[inner + 1]])
                keys, n = np.unique(keys, return_counts=True)
                for i in range(0, len(keys), 1 << 16):
                    part = keys[i:i + (1 << 16)]
                    yield pa.record_batch({"word": words[part // slots].view(np.int64),
                                           "slot": (part % slots).astype(np.int32),
                                           "n": n[i:i + (1 << 16)]})
        at = np.flatnonzero(pairs)
        yield pa.record_batch({"word": at, "slot": np.full(len(at), slots, np.int32),
                               "n": pairs[at]})
    return build


def place(contexts: np.ndarray, between: np.ndarray, smoothing: float) -> np.ndarray:
    """Best class of each word by its counts of classes before and after (2 C columns)."""
    count = len(between)
    table = np.log(between + smoothing)
    rows = np.log(between.sum(1) + smoothing * count)
    cols = np.log(between.sum(0) + smoothing * count)
    gain = contexts[:, :count] @ (table - cols) + contexts[:, count:] @ (table - rows[:, None]).T
    gain[:, -1] = -np.inf
    return gain.argmax(1)


def _neighbours(seen: pa.ListArray, count: int) -> np.ndarray:
    """Counts of classes before and after (2 C columns) from lists of joint slots with their counts."""
    row = np.repeat(np.arange(len(seen)), seen.value_lengths().to_numpy())
    flat = seen.flatten().to_numpy()
    slot, n = flat & 0xFFFF, flat >> 16
    known = slot < count * count
    row, slot, n = row[known] * 2 * count, slot[known], n[known]
    size = len(seen) * 2 * count
    counts = np.bincount(row + slot // count, n, size) + np.bincount(row + count + slot % count, n, size)
    return counts.reshape(len(seen), 2 * count)


def _placed(between: np.ndarray, smoothing: float):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _neighbours(batch.column("seen"), len(between))
            yield pa.record_batch({"word": batch.column("word"), "class": place(
                counts, between, smoothing).astype(np.int32)})
    return build


@dataclass(frozen=True)
class BrownModel:
    """Classes and counts of the most frequent words, class sizes, and numbers of words."""

    known: Classes
    local_counts: np.ndarray
    class_log: np.ndarray
    tokens: int
    distinct: int


def train(spark: SparkSession, docs: DataFrame, settings: BrownSettings,
          stages: StageTables) -> tuple[BrownModel, DataFrame]:
    """The model of the texts of ``docs``, and the table of known words (word, n, class)."""
    texts, classes = docs.select("text"), settings.classes
    if not 2 <= classes <= 255:
        raise ValueError("classes must be 2 to 255: a pair of them is a 16-bit slot")
    counts = stages.get("counts", lambda: texts.mapInArrow(
        _word_counts(settings.shapes), "word long, shape long, n long").groupBy("word").agg(
            F.sum("n").alias("n"), F.first("shape").alias("shape")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    end = int(END)
    top = counts.filter(F.col("word") != end).orderBy(F.desc("n"), "word").limit(
        settings.frequent).select("word").toArrow()["word"].to_numpy().view(np.uint64)
    units = Units(np.sort(top), settings.shapes)
    table = texts.mapInArrow(_bigrams(units), "pair long, n long").groupBy("pair").agg(
        F.sum("n").alias("n")).toArrow()
    bigrams = np.zeros(units.size * units.size)
    bigrams[table["pair"].to_numpy()] = table["n"].to_numpy()
    of = exchange(bigrams.reshape(units.size, units.size), classes, settings.sweeps)

    fixed = spark.createDataFrame(pa.table({
        "word": np.append(units.words, END).view(np.int64),
        "fixed": np.append(of[:len(units.words)], of[-1]).astype(np.int32)}))
    known = Classes(units, of, units.words, of[:len(units.words)])
    for number in range(settings.rounds):
        # few rows of a word meet before the shuffle, so they are added up after it only; a list
        # entry is n * 2**16 + slot
        seen = stages.get(f"contexts-{number}", lambda k=known: texts.mapInArrow(
            _contexts(k, units.words, classes, joint=True), "word long, slot int, n long").repartition(
                "word").groupBy("word", "slot").agg(F.sum("n").alias("n")).groupBy("word").agg(
                    F.collect_list(F.shiftleft("n", 16).bitwiseOR(F.col("slot"))).alias("seen")))
        slot, total_slot = F.col("entry").bitwiseAND(0xFFFF), classes * classes
        pairs = seen.filter(F.col("word").between(0, classes * classes - 1)).select(
            "word", F.explode("seen").alias("entry")).filter(slot == total_slot).select(
                "word", F.shiftright("entry", 16).alias("n")).toArrow()
        between = np.zeros(classes * classes)
        between[pairs["word"].to_numpy()] = pairs["n"].to_numpy()
        between = between.reshape(classes, classes)
        words = stages.get(f"words-{number}", lambda s=seen, b=between: counts.select("word", "n").join(
            s.filter(F.exists("seen", lambda x: x.bitwiseAND(0xFFFF) < total_slot)).mapInArrow(
                _placed(b, settings.smoothing), "word long, class int"), "word", "left").join(
            F.broadcast(fixed), "word", "left").select(
                "word", "n", F.coalesce("fixed", "class").alias("class")))
        if number + 1 < settings.rounds:
            heard = words.filter((F.col("n") >= settings.least) & (F.col("word") != end)).toArrow()
            known = Classes(units, of, heard["word"].to_numpy().view(np.uint64),
                            heard["class"].to_numpy().astype(np.int64))
    sums = words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    sizes = np.zeros(classes)
    sizes[sums["class"].to_numpy()] = sums["n"].to_numpy() + sums["v"].to_numpy()
    local = words.orderBy(F.desc("n"), "word").limit(settings.local).toArrow()
    hashes = local["word"].to_numpy().view(np.uint64)
    model = BrownModel(Classes(units, of, hashes, local["class"].to_numpy().astype(np.int64)),
                       local["n"].to_numpy().astype(np.int64)[np.argsort(hashes)],
                       np.log10(sizes + 1), int(total.n), int(total.v))
    return model, words


def _coded(model: BrownModel):
    """Classes of each row's tokens; words that are not local are listed with their places."""
    logs = np.log10(model.local_counts + 1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, chunk in textbytes.chunks(batch.column("text")):
                hashes, shape, rows = tokens(chunk, model.known.shapes)
                of, found = model.known.of(hashes, shape)
                at, _ = _lookup(model.known.words, hashes)
                sums = np.bincount(rows, np.where(found, logs[at], 0) if len(logs) else None,
                                   minlength=chunk.rows) if len(logs) else np.zeros(chunk.rows)
                rare = ~found
                cuts = np.concatenate([[0], np.cumsum(np.bincount(rows[rare], minlength=chunk.rows))])
                ends = np.cumsum(chunk.n_words + 1)
                places = np.arange(len(of)) - (ends - chunk.n_words - 1)[rows]
                codes = of.astype(np.uint16)
                own = batch.slice(low, high - low)
                yield pa.record_batch({
                    "rid": own.column("rid"), "doc_id": own.column("doc_id"),
                    "held_out": own.column("held_out"), "n_tokens": chunk.n_words + 1,
                    "found": np.bincount(rows[found], minlength=chunk.rows), "logs": sums,
                    "codes": pa.array([codes[e - n:e].tobytes() for e, n in zip(
                        ends, chunk.n_words + 1, strict=True)], pa.binary()),
                    "rare": pa.ListArray.from_arrays(
                        pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays(
                            [pa.array(places[rare]), pa.array(hashes[rare].view(np.int64))],
                            ["place", "word"]))})
    return build


def _sequences(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Classes of each row with those of its rare known words in place."""
    for codes, rare in zip(batch.column("codes"), batch.column("rare"), strict=True):
        of = np.frombuffer(codes.as_py(), np.uint16).astype(np.int64)
        if rare.is_valid and len(rare):
            of[rare.values.field("place").to_numpy()] = rare.values.field("class").to_numpy()
        yield of


def _transitions(classes: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for of in _sequences(batch):
                before = np.concatenate([[classes - 1], of[:-1]])
                seen += np.bincount(before * classes + of, minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.record_batch({"pair": at, "n": seen[at]})
    return build


def _score(transitions: np.ndarray, class_log: np.ndarray):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros(batch.num_rows)
            for i, of in enumerate(_sequences(batch)):
                before = np.concatenate([[len(class_log) - 1], of[:-1]])
                sums[i] = (transitions[before, of] - class_log[of]).sum()
            own = [c for c in batch.schema.names if c not in ("codes", "rare")]
            yield pa.record_batch({c: batch.column(c) for c in own} | {"classes": sums})
    return build


def scores(spark: SparkSession, docs: DataFrame, held_out=None,
           settings: BrownSettings = BrownSettings()) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``held_out`` is a boolean column of doc_id; rows where it is true do not train.
    """
    stages = StageTables(spark)
    held_out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).withColumn("held_out", held_out)
    model, words = train(spark, rows.filter(~F.col("held_out")), settings, stages)
    kinds = "rid long, doc_id long, held_out boolean, n_tokens long, found long, logs double"
    parts = stages.get("parts", lambda: rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(
        _coded(model), f"{kinds}, codes binary, rare array<struct<place: bigint, word: bigint>>"))
    rare = parts.select("rid", F.inline("rare")).join(words, "word").groupBy("rid").agg(
        F.collect_list(F.struct("place", "class")).alias("rare"),
        F.sum(F.log10(F.col("n") + 1)).alias("rare_logs"))
    coded = stages.get("coded", lambda: parts.drop("rare").join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("found") + F.coalesce(F.size("rare"), F.lit(0))).alias("found"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))).alias("logs"), "codes", "rare"))
    a, classes = settings.smoothing, settings.classes
    table = coded.filter(~F.col("held_out")).select("codes", "rare").mapInArrow(
        _transitions(classes), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    between = np.zeros(classes * classes)
    between[table["pair"].to_numpy()] = table["n"].to_numpy()
    between = between.reshape(classes, classes)
    transitions = np.log10((between + a) / (between.sum(1, keepdims=True) + a * classes))
    scored = coded.mapInArrow(_score(transitions, model.class_log), kinds.removeprefix("rid long, ")
                              + ", classes double")
    logs = F.col("logs")
    space = float(np.log10(model.tokens + model.distinct + 1))
    score = logs + F.col("classes")
    return scored.select(
        "doc_id", "held_out", "n_tokens", F.col("found").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * space).alias("base_score"), score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))
