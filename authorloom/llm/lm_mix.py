"""Language-model score of whole texts: logistic mixing of hashed-context bit predictors.

A text is its UTF-8 bytes and an end mark (0xFF, which no text has), coded bit by bit. For each
of ``ORDERS`` the bytes before are hashed to a page of ``PAGE`` slots for either half of the next byte; a
slot counts the zeros and ones that followed, which is a predictor that moves by 1/n at each
bit. The predictions, as log odds, are added with weights chosen by a gate: the bit and the number of orders
that know their slot. A last table refines the sum by the bits of the byte so far. The chance of
the text is the product over its bits, so chances of all texts add up to one.

Learning is one pass over all training texts. Each task goes through its texts in blocks, predicts
every chunk before it counts it, moves the weights against the error, and then counts the chunk. The
counts of all tasks are added slot by slot, the weights are averaged by the bits they saw. So
the model covers every training text; its size is fixed by ``SLOT_BITS``.

Equal windows (the byte and the five before it) have equal predictions; each block treats them once.

Beside it stands the base score: counts of all training words, smoothed by 0.1.

Rules: null and empty texts are the end mark alone. Rows without doc_id count as training rows. Repeated rows count and are
scored each. Without training texts every bit has chance ½ and the base score is 0. An
empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorloom.llm import frequent, shared

ORDERS = (1, 2, 3, 4, 5)
SLOT_BITS = (17, 20, 22, 22, 22)
PAGE = 16
REACH = max(ORDERS)
END = 0xFF
BLOCK = 3 << 20
"""Bytes whose windows are treated together."""
WORDS = 1 << 19
"""Distinct words that a task gathers before it sends them."""
CHUNK = 1 << 12
"""Distinct windows between two steps of the weights."""
RANGE = 1 << 16
"""Slots that are added up together."""
DELTA = 0.4
RATE = 0.1
LEVELS = len(ORDERS) + 1
BUCKETS = 25
SPAN = 12.0
FLOOR = 1 / (1 << 16)
PRIOR = 0.1
"""What the base score adds to every count."""

_FIRST = np.concatenate(([0], np.cumsum([1 << b for b in SLOT_BITS])))
_SLOTS = int(_FIRST[-1])
_byte = np.arange(256)
_BITS = np.stack([(_byte >> (7 - b)) & 1 for b in range(8)]).astype(np.uint8)
_PART = np.stack([(1 << b) | (_byte >> (8 - b)) for b in range(8)])
_NODE = np.stack([(1 << (b % 4)) | (((_byte >> 4) if b < 4 else (_byte & 15)) >> (4 - b % 4)) for b in range(8)])
_LOWER = shared.lower_ascii()
_WORD = np.ones(256, bool)
_WORD[9:14] = _WORD[32] = False
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(doc_id):
    """True for the tenth of the documents that is not learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, each after ``REACH`` zeros and before an end mark; start of each in it)."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    starts = offsets[:-1] + np.arange(n) * (REACH + 1) + REACH
    out = np.zeros(len(data) + n * (REACH + 1), np.uint8)
    out[shared.ranges(starts, sizes)] = data
    out[starts + sizes] = END
    return out, starts


def windows(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[np.ndarray, int]]:
    """Sorted (window << 16 | text) of the positions of a block, in parts of ``limit``; and the first text of the part.

    A window is 48 bits: the byte in the low eight and the five before it. A part has fewer than 65,536 texts."""
    out, starts = stream(data, offsets)
    ends = starts + np.diff(offsets) + 1
    low = REACH
    while low < len(out):
        first = int(np.searchsorted(ends, low, side="right"))
        last = min(len(starts), first + (1 << 16))
        high = min(low + limit, int(ends[last - 1]))
        key = np.zeros(high - low, np.uint64)
        for back in range(REACH, -1, -1):
            key <<= np.uint64(8)
            key |= out[low - back : high - back]
        last = int(np.searchsorted(starts, high))
        sizes = np.minimum(ends[first:last], high) - np.maximum(starts[first:last], low)
        real = shared.ranges(np.maximum(starts[first:last], low) - low, sizes)
        key = key[real]
        key <<= np.uint64(16)
        key |= np.repeat(np.arange(last - first, dtype=np.uint64), sizes)
        key.sort()
        if len(key):
            yield key, first
        low = high


def slots(window: np.ndarray) -> list[np.ndarray]:
    """For each order the slots of the eight bits of the windows' bytes, shape (8, windows)."""
    byte = (window & np.uint64(255)).astype(np.intp)
    nodes = _NODE[:, byte]
    high = (window >> np.uint64(4)) & np.uint64(15)
    past = window >> np.uint64(8)
    out = []
    for order, bits, first in zip(ORDERS, SLOT_BITS, _FIRST, strict=False):
        context = (past & np.uint64((1 << 8 * order) - 1)) * _SPREAD
        context ^= context >> np.uint64(29)
        one = context * _HALF
        two = (context + high + np.uint64(1)) * _SPREAD
        two ^= two >> np.uint64(32)
        two *= _HALF
        pages = np.uint64(64 - bits + 4)
        slot = np.empty((8, len(window)), np.intp)
        slot[:4] = (one >> pages).astype(np.intp) * PAGE + int(first)
        slot[4:] = (two >> pages).astype(np.intp) * PAGE + int(first)
        slot += nodes
        out.append(slot)
    return out


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def start_weights() -> np.ndarray:
    """(8 bits × levels, orders + 1): all known orders alike, the last column is a bias."""
    weights = np.full((8, LEVELS, len(ORDERS) + 1), 0.3, np.float32)
    weights[:, :, -1] = 0
    return weights.reshape(8 * LEVELS, -1)


def mixed(odds: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log odds of each bit, gate of each bit) from the odds of the orders."""
    level = (odds[0] != 0).astype(np.intp)
    for one in odds[1:]:
        level += one != 0
    level += (np.arange(8) * LEVELS)[:, None]
    total = weights[:, -1][level]
    for order, one in enumerate(odds):
        total += weights[:, order][level] * one
    return np.clip(total, -SPAN + 1e-3, SPAN - 1e-3), level


def _cell(byte: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Cell of the refining table: bits of the byte so far, and the mixed log odds in ``BUCKETS`` steps."""
    step = ((total + SPAN) * (BUCKETS / (2 * SPAN))).astype(np.intp)
    return _PART[:, byte] * BUCKETS + step


class Learner:
    """What one task learns: counts of slots, weights, and the table that refines."""

    def __init__(self) -> None:
        self.counts = np.zeros((_SLOTS, 2), np.uint32)
        self.weights = start_weights()
        self.seen = np.zeros(8 * LEVELS)
        self.refine = np.zeros((256 * BUCKETS, 2))
        self.bits = 0

    def learn(self, key: np.ndarray) -> None:
        """Predict, correct and count the sorted keys of one block."""
        window = key >> np.uint64(16)
        new = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
        times = np.diff(np.append(new, len(window))).astype(np.uint32)
        window = window[new]
        steps = max(1, -(-len(window) // CHUNK))
        for i in range(steps):
            self._chunk(window[i::steps], times[i::steps])
        self.bits += 8 * len(key)

    def _chunk(self, window: np.ndarray, times: np.ndarray) -> None:
        byte = (window & np.uint64(255)).astype(np.intp)
        bit = _BITS[:, byte]
        where = slots(window)
        odds = []
        for slot in where:
            pair = np.log(self.counts.take(slot, axis=0).astype(np.float32) + np.float32(DELTA))
            odds.append(pair[..., 1] - pair[..., 0])
        total, gate = mixed(odds, self.weights)
        miss = (bit - _squash(total)) * times.astype(np.float32)
        gates = gate.ravel()
        every = np.tile(times, 8)
        n = np.bincount(gates, every, 8 * LEVELS)
        self.seen += n
        pace = RATE / np.maximum(n, 1)
        for order, one in enumerate(odds):
            self.weights[:, order] += pace * np.bincount(gates, (miss * one).ravel(), 8 * LEVELS)
        self.weights[:, -1] += pace * np.bincount(gates, miss.ravel(), 8 * LEVELS)
        cell = (_cell(byte, total) * 2 + bit).ravel()
        self.refine += np.bincount(cell, every, 512 * BUCKETS).reshape(-1, 2)
        flat = self.counts.reshape(-1)
        for slot in where:
            np.add.at(flat, (slot * 2 + bit).ravel(), every)

    def parts(self) -> Iterator[tuple[int, bytes]]:
        """(range of slots, their counts that are not 0)."""
        for place, first in enumerate(range(0, _SLOTS, RANGE)):
            part = self.counts[first : first + RANGE]
            used = np.flatnonzero(part.any(axis=1))
            if len(used):
                yield place, packed(used, part[used])


def packed(used: np.ndarray, pair: np.ndarray) -> bytes:
    """Counts of the used slots of a range: a bit map, low bytes, and the few larger ones in full."""
    bits = np.zeros(RANGE, np.uint8)
    bits[used] = 1
    large = np.flatnonzero(pair.max(axis=1) > 255)
    low = np.packbits(bits).tobytes() + pair.astype(np.uint8).T.tobytes()
    return pickle.dumps((zstandard.compress(low, 1), large.astype(np.uint32), pair[large]), 5)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(used slots, their counts) of a range."""
    low, large, full = pickle.loads(blob)
    data = np.frombuffer(zstandard.decompress(low), np.uint8)
    used = np.flatnonzero(np.unpackbits(data[: RANGE // 8]))
    pair = data[RANGE // 8 :].reshape(2, -1).T.astype(np.int64)
    pair[large] = full
    return used, pair


@dataclass(frozen=True)
class Model:
    """Log odds of all slots, weights of all gates, chance of all cells of the refining table."""

    odds: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    def chance(self, window: np.ndarray) -> np.ndarray:
        """log10 of the chance of each window's byte after the bytes before it."""
        out = np.empty(len(window))
        for first in range(0, len(window), CHUNK):
            part = window[first : first + CHUNK]
            byte = (part & np.uint64(255)).astype(np.intp)
            total, _ = mixed([self.odds[slot] for slot in slots(part)], self.weights)
            one = 0.5 * (_squash(total) + self.refined[_cell(byte, total)])
            right = np.where(_BITS[:, byte] == 1, one, 1 - one)
            out[first : first + CHUNK] = np.log10(np.clip(right, FLOOR, 1 - FLOOR)).sum(axis=0, dtype=np.float64)
        return out

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 of the chance of each whole text."""
        out = np.zeros(len(offsets) - 1)
        for key, first in windows(data, offsets):
            window = key >> np.uint64(16)
            new = np.concatenate(([True], window[1:] != window[:-1]))
            chance = self.chance(window[new])[np.cumsum(new) - 1]
            sums = np.bincount((key & np.uint64(0xFFFF)).astype(np.intp), chance)
            out[first : first + len(sums)] += sums
        return out


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(words of all texts with A-Z lower-cased, as an exact dictionary; offsets of the texts)."""
    data = _LOWER[data]
    starts, ends, bounds = shared.words(data, offsets, _WORD)
    at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    kept = np.ascontiguousarray(data[_WORD[data]])
    array = pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(kept)]
    )
    return array.dictionary_encode(), bounds


def gathered(docs: DataFrame) -> DataFrame:
    """What all training texts say, one part for each task: (kind, word, place, n, blob).

    ``word`` rows count words (null: end marks), ``slots`` rows a range of slots, ``mixer`` rows hold
    the weights, the bits they saw and the refining counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner()
        texts, counts = 0, []
        for block in shared.gathered(batches, BLOCK):
            texts += block.num_rows
            data, offsets = shared.utf8(block.column("text"))
            words, _ = text_words(data, offsets)
            n = pa.array(np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)))
            counts.append(pa.table({"word": words.dictionary, "n": n}))
            if sum(c.num_rows for c in counts) > WORDS:
                counts = [_added(counts)]
                if counts[0].num_rows > WORDS // 2:
                    yield from _word_rows(counts.pop())
            for key, _ in windows(data, offsets):
                learner.learn(key)
        if texts:
            if counts:
                yield from _word_rows(_added(counts))
            yield _rows("word", 1, n=pa.array([texts], pa.int64()))
            for place, blob in learner.parts():
                yield _rows("slots", 1, place=pa.array([place], pa.int32()), blob=pa.array([blob]))
            blob = pickle.dumps((learner.weights, learner.seen, learner.refine), 5)
            yield _rows("mixer", 1, n=pa.array([learner.bits], pa.int64()), blob=pa.array([blob]))
        del learner, counts
        shared.give_back()

    return docs.select("text").mapInArrow(run, "kind string, word string, place int, n long, blob binary")


def _added(counts: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(counts).group_by("word").aggregate([("n", "sum")])
    return pa.table({"word": out.column("word"), "n": out.column("n_sum")})


def _word_rows(counts: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in counts.to_batches(max_chunksize=1 << 15):
        yield _rows("word", batch.num_rows, word=batch.column("word").cast(pa.string()), n=batch.column("n"))


def _rows(kind: str, count: int, **given: pa.Array) -> pa.RecordBatch:
    kinds = {"word": pa.string(), "place": pa.int32(), "n": pa.int64(), "blob": pa.binary()}
    columns = [given.get(name, pa.nulls(count, of)) for name, of in kinds.items()]
    return pa.RecordBatch.from_arrays([pa.array([kind] * count), *columns], ["kind", *kinds])


def summed_slots(parts: DataFrame) -> DataFrame:
    """(place, blob): log odds of every range of slots, from the sums of all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = None, None
        for batch in batches:
            for at, blob in zip(batch.column("place").to_pylist(), batch.column("blob"), strict=True):
                if at != place:
                    if place is not None:
                        yield _odds(place, total)
                    place, total = at, np.zeros((RANGE, 2))
                used, pair = unpacked(blob.as_buffer())
                total[used] += pair
        if place is not None:
            yield _odds(place, total)

    ranges = parts.repartition("place").sortWithinPartitions("place")
    return ranges.select("place", "blob").mapInArrow(run, "place int, blob binary")


def _odds(place: int, total: np.ndarray) -> pa.RecordBatch:
    odds = np.log((total[:, 1] + DELTA) / (total[:, 0] + DELTA)).astype(np.float16)
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([odds.tobytes()])], ["place", "blob"])


def mixer_sums(parts: DataFrame) -> DataFrame:
    """One row for each partition: weights by the bits they saw, those bits, and the refining counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column("blob"):
                weights, seen, refine = pickle.loads(blob.as_buffer())
                one = (weights * seen[:, None], seen, refine)
                total = one if total is None else tuple(x + y for x, y in zip(total, one, strict=True))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total, 5)])], ["blob"])

    return parts.select("blob").mapInArrow(run, "blob binary")


def model(parts: DataFrame) -> Model:
    """The model from what was gathered; its size does not depend on the corpus."""
    odds = np.zeros(_SLOTS, np.float16)
    for row in summed_slots(parts.where("kind = 'slots'")).toLocalIterator():
        part = np.frombuffer(row.blob, np.float16)
        odds[row.place * RANGE : (row.place + 1) * RANGE] = part[: _SLOTS - row.place * RANGE]
    weights, refine = start_weights(), np.zeros((256 * BUCKETS, 2))
    sums, seen = np.zeros(weights.shape), np.zeros(8 * LEVELS)
    for row in mixer_sums(parts.where("kind = 'mixer'").coalesce(64)).toLocalIterator():
        one, n, cells = pickle.loads(row.blob)
        sums, seen, refine = sums + one, seen + n, refine + cells
    known = seen > 0
    weights[known] = sums[known] / seen[known, None]
    middle = _squash((np.arange(BUCKETS) + 0.5) * (2 * SPAN / BUCKETS) - SPAN)
    refined = (refine[:, 1] + 8 * np.tile(middle, 256)) / (refine.sum(axis=1) + 8)
    return Model(odds, weights, refined.astype(np.float32))


def score(docs: DataFrame, learned: Model, counts: DataFrame, ends: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``counts`` has (key, c) for all training words, ``ends`` is the number of training texts."""
    spark = docs.sparkSession
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = total + ends, distinct + (1 if ends else 0)
    below = np.log10(n + PRIOR * (v + 1)) if n else np.log10(PRIOR)
    least = frequent.least_count(n)
    often = counts.where(F.col("c") >= least).toArrow()  # frequent.KEYS rows at most
    often = often.column("key").combine_chunks().cast(pa.large_string()), often.column("c").to_numpy()
    sent = spark.sparkContext.broadcast((learned, often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, (keys, c) = sent.value
        mixer = Model(mixer.odds.astype(np.float32), mixer.weights, mixer.refined)
        logs = np.log10(c + PRIOR) - below
        end = np.log10(ends + PRIOR) - below
        for block in shared.gathered(batches, BLOCK):
            data, offsets = shared.utf8(block.column("text"))
            words, bounds = text_words(data, offsets)
            chance = mixer.texts(data, offsets)
            place = pc.index_in(words.dictionary, value_set=keys).fill_null(-1).to_numpy()
            ids = words.indices.to_numpy()
            text = np.repeat(np.arange(block.num_rows), np.diff(bounds))
            known = place >= 0
            value = np.where(known, logs[np.maximum(place, 0)] if len(logs) else 0.0, 0.0)
            base = np.bincount(text, value[ids], block.num_rows) + end
            common = np.bincount(text, known[ids], block.num_rows).astype(np.int64) + (ends > 0)
            rare = ~known[ids]
            pairs, times = np.unique(text[rare] * len(known) + ids[rare], return_counts=True)
            edges = np.searchsorted(pairs, np.arange(block.num_rows + 1) * len(known))
            spelled = words.dictionary.take(pa.array(pairs % max(len(known), 1))).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array(np.diff(bounds) + 1, pa.int64()),
                    pa.array(common, pa.int64()),
                    pa.array(base),
                    pa.array(chance),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), spelled),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(times, pa.int64())),
                ],
                ["doc_id", "n_tokens", "common", "base", "score", "keys", "times"],
            )
        del mixer
        shared.give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_tokens long, common long, base double, score double, keys array<string>, times array<long>",
    )
    rows = shared.stored(rows.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    log = F.log10(F.coalesce("c", F.lit(0)) + PRIOR) - F.lit(float(below))
    rare = frequent.sum_over_rare(
        rows,
        counts.where(F.col("c") < least),
        {"rare_base": F.col("times") * log, "rare": F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)},
    )
    return rows.join(rare, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("common") + F.coalesce("rare", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def language_model(docs: DataFrame) -> DataFrame:
    """Learn from all rows outside the held-out tenth and score every row."""
    shared.small_batches(docs.sparkSession)
    shared.small_blobs(docs.sparkSession)
    parts = shared.stored(gathered(docs.where(~held_out(F.col("doc_id")))), "lm-parts")
    said = parts.where("kind = 'word'")
    counts = said.where("word is not null").groupBy(F.col("word").alias("key")).agg(F.sum("n").alias("c"))
    counts = shared.stored(counts, "lm-words")
    ends = said.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    learned = model(parts)
    shared.drop(parts)
    return score(docs, learned, counts, ends)
