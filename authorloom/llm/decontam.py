"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a block of documents in one task. Its word suffixes, ``DEPTH`` words deep, are
sorted by prefix doubling; every test suffix is binary-searched in every shard. All places in
the stretch of equal suffixes are compared with it word by word to the true end of the match,
so that every maximal verbatim match of every document is found with its place and length.
Words of matches of ``WINDOW`` words or more, or of a whole shorter item, are hit; documents
that are mostly short and hit go.

The benchmark reaches the tasks in blocks of about ``TEST_BYTES`` of text. Documents are read
once; each shard is compared with one block after the other, and every row is judged by the
matches of all of them, whatever its id.

Rules: A-Z are lower-cased; words are runs of digits, letters and bytes from 0x80. An item of
fewer than 13 words, but not none, is one window. Null and empty texts have no words, and no
item without words occurs anywhere. Repeated items count once per item_id. Rows of documents
are judged one by one; repeated ids get the same result for the same text. Documents' other
columns are ignored here and kept by ``keep_uncontaminated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorloom.llm import shared

WINDOW = 13
DEPTH = 16
TEST_BYTES = 8 << 20
PAIRS = 1 << 20
"""Places that are compared at a time."""
STRIDE = 32
"""Words by which matches are extended at a time."""
SHARD_BYTES = 1 << 20

_LOWER = shared.lower_ascii()
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts, offsets per text). No hash is 0 or the largest."""
    data, offsets = shared.utf8(texts)
    data = _LOWER[data]
    starts, ends, bounds = shared.words(data, offsets, _WORD)
    h = shared.RollingHash(data, shared.WORD_BASE).of(starts, ends)
    return np.clip(h, 1, np.iinfo(np.uint64).max - np.uint64(1)), bounds


@dataclass(frozen=True)
class TestSuffixes:
    """All suffixes of the items: the words of distinct texts with a 0 after each, and whose they are."""

    sequence: np.ndarray  # padded with 0 for the longest comparison
    start: np.ndarray  # of each suffix in the sequence
    length: np.ndarray  # words to the end of the item
    first: np.ndarray  # whether the suffix is the whole item
    text: np.ndarray  # number of its text
    item: list[tuple[str, ...]]  # items of each text


def test_suffixes(items: list[tuple[str, str | None]]) -> TestSuffixes:
    """Suffixes of (item_id as text, text) rows; texts of equal words share their items."""
    hashes, bounds = word_hashes(pa.array([t for _, t in items], pa.string()))
    found: dict[bytes, set[str]] = {}
    for (name, _), begin, end in zip(items, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end > begin:
            found.setdefault(hashes[begin:end].tobytes(), set()).add(name)
    sizes = np.array([len(text) // 8 for text in found], np.int64)
    sequence = np.zeros(int(sizes.sum()) + len(sizes) + DEPTH + STRIDE, np.uint64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(text)) + text
    sequence[start] = np.frombuffer(b"".join(found), np.uint64)
    length = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))
    return TestSuffixes(
        sequence, start, length, length == sizes[text], text, [tuple(sorted(names)) for names in found.values()]
    )


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Places of the suffixes of ``sequence`` in order of their first ``DEPTH`` values."""
    order = np.argsort(sequence, kind="stable")
    width = 1
    ordered = sequence[order]
    new = np.concatenate(([False], ordered[1:] != ordered[:-1]))
    while True:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) + 1
        if width >= DEPTH:
            return order
        later = np.zeros(len(rank), np.int64)
        later[: max(len(rank) - width, 0)] = rank[width:]
        pair = (rank << 32) | later
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        new = np.concatenate(([False], ordered[1:] != ordered[:-1]))
        width *= 2


class Shard:
    """Suffix array over the words of a block of documents, kept apart by single ends."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray):
        n = len(bounds) - 1
        # one end word after each document; ends equal nothing that is searched for
        self.owner = np.repeat(np.arange(n), np.diff(bounds) + 1)
        self.sequence = np.full(len(hashes) + n + DEPTH + STRIDE, np.iinfo(np.uint64).max, np.uint64)
        self.first = bounds[:-1] + np.arange(n)
        self.sequence[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(bounds))] = hashes
        self.array = suffix_array(self.sequence[: len(hashes) + n])

    def search(self, test: TestSuffixes, rows: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``test`` the stretch [low, high) of the array whose suffixes share ``depth`` words."""
        start = test.start[rows]
        return self._bound(test.sequence, start, depth, False), self._bound(test.sequence, start, depth, True)

    def _bound(self, words: np.ndarray, start: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
        low = np.zeros(len(start), np.int64)
        high = np.full(len(start), len(self.array), np.int64)
        while (open_rows := np.flatnonzero(low < high)).size:
            middle = (low[open_rows] + high[open_rows]) // 2
            place = self.array[middle]
            less = np.zeros(len(open_rows), bool)
            equal = np.ones(len(open_rows), bool)
            for depth in range(int(length[open_rows].max())):
                here, there = self.sequence[place + depth], words[start[open_rows] + depth]
                active = equal & (depth < length[open_rows])
                less |= active & (here < there)
                equal &= ~active | (here == there)
            right = less | equal if upper else less
            low[open_rows[right]] = middle[right] + 1
            high[open_rows[~right]] = middle[~right]
        return low

    def matches(self, test: TestSuffixes, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, row of the test suffix, words) of every match that can't be extended to either side
        and has ``least`` words, which are ``DEPTH`` at most, or is a whole item of two words or more.

        With ``least`` = ``WINDOW`` an item of one word is such a match too."""
        if not len(test.start) or not len(self.array):
            return
        depth = np.minimum(test.length, least)
        low, high = self.search(test, np.arange(len(depth)), depth)
        whole = test.first & (test.length >= (1 if least == WINDOW else 2))
        rows = np.flatnonzero((high > low) & ((test.length >= least) | whole))
        count = high[rows] - low[rows]
        ends = np.cumsum(count)
        begin = 0
        while begin < len(rows):
            before = int(ends[begin - 1]) if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
            part = slice(begin, stop)
            place = self.array[shared.ranges(low[rows[part]], count[part])]
            row = np.repeat(rows[part], count[part])
            start = test.start[row]
            # begun one word earlier, the match is longer and found there
            longer = (place > 0) & (start > 0) & (self.sequence[place - 1] == test.sequence[start - 1])
            place, row, start = place[~longer], row[~longer], start[~longer]
            yield place, row, self._extended(test, place, start, depth[row])
            begin = stop

    def _extended(self, test: TestSuffixes, place: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Words of each match to its true end, ``length`` of which are known to be equal."""
        length = length.copy()
        ahead = np.arange(STRIDE)
        for begin in range(0, len(place), PAIRS // STRIDE):
            going = np.arange(begin, min(begin + PAIRS // STRIDE, len(place)))
            while len(going):
                here = self.sequence[(place[going] + length[going])[:, None] + ahead]
                there = test.sequence[(start[going] + length[going])[:, None] + ahead]
                differ = here != there
                ended = differ.any(axis=1)
                length[going] += np.where(ended, differ.argmax(axis=1), STRIDE)
                going = going[~ended]
        return length


def _judge(block: pa.RecordBatch, tests: Iterable[TestSuffixes]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Per document of a shard: number of words, words that are hit, items that occur."""
    hashes, bounds = word_hashes(block.column("text"))
    shard = Shard(hashes, bounds)
    hit_from, hit_to = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    names: list[set[str]] = [set() for _ in range(block.num_rows)]
    for test in tests:
        for place, row, length in shard.matches(test, WINDOW):
            hit_from.append(place), hit_to.append(place + length)
            pairs = np.unique(np.stack([shard.owner[place], test.text[row]]), axis=1)
            for doc, text in pairs.T.tolist():
                names[doc].update(test.item[text])
    # ends between documents keep their stretches apart
    begin, end = shared.merged(np.concatenate(hit_from), np.concatenate(hit_to))
    hit = np.zeros(block.num_rows, np.int64)
    np.add.at(hit, shard.owner[begin], end - begin)
    return np.diff(bounds), hit, names


def _bad(words: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Contaminated: at least a twentieth of the words is hit."""
    return (hit > 0) & (20 * hit >= words)


def _n_blocks(rows: DataFrame) -> int:
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return -(-total // TEST_BYTES) or 1


def _shipped(benchmark: DataFrame) -> list[Broadcast]:
    """The benchmark in blocks of about ``TEST_BYTES`` of text, of which the driver holds one at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(
        "item_id is not null and text is not null"
    )
    n = _n_blocks(rows)
    out = []
    for number in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == number)
        test = test_suffixes([(r.item_id, r.text) for r in part.collect()])
        out.append(benchmark.sparkSession.sparkContext.broadcast(test))
    return out


def _received(shipped: list[Broadcast]) -> Iterator[TestSuffixes]:
    """The blocks one after the other; of several a worker holds one at a time."""
    for block in shipped:
        yield block.value
        if len(shipped) > 1:
            vars(block).pop("_value", None)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``."""
    shared.small_batches(docs.sparkSession)
    shipped = _shipped(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in shared.blocks(batches, limit=SHARD_BYTES):
            words, hit, names = _judge(block, _received(shipped))
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array(words, pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array([len(found) for found in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() for found in names]),
                    pa.array(_bad(words, hit)),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {columns}")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated; each is judged by its own text."""
    shared.small_batches(docs.sparkSession)
    shipped = _shipped(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in shared.blocks(batches, limit=SHARD_BYTES):
            words, hit, _ = _judge(block, _received(shipped))
            yield block.filter(pa.array(~_bad(words, hit)))

    return docs.mapInArrow(run, docs.schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, words, doc_word): per document and item the words of their longest verbatim
    match, and the first document word where one of that length starts.

    Matches of one word are left out."""
    shared.small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    shipped = _shipped(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in shared.blocks(batches, limit=SHARD_BYTES):
            shard = Shard(*word_hashes(block.column("text")))
            best: dict[tuple[int, str], tuple[int, int]] = {}
            for test in _received(shipped):
                for place, row, length in shard.matches(test, 2):
                    owner, text = shard.owner[place], test.text[row]
                    order = np.lexsort((place, -length, text, owner))
                    owner, text, place, length = owner[order], text[order], place[order], length[order]
                    new = np.ones(len(order), bool)
                    new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
                    at = place[new] - shard.first[owner[new]]
                    found = (owner[new], text[new], length[new], at)
                    for doc, number, words, word in zip(*(x.tolist() for x in found), strict=True):
                        for name in test.item[number]:
                            best[doc, name] = min(best.get((doc, name), (0, 0)), (-words, word))
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").take(pa.array([doc for doc, _ in best], pa.int64())),
                    pa.array([name for _, name in best], pa.string()),
                    pa.array([-words for words, _ in best.values()], pa.int32()),
                    pa.array([word for _, word in best.values()], pa.int32()),
                ],
                ["doc_id", "item_id", "words", "doc_word"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"doc_id {kind}, item_id string, words int, doc_word int")
    return out.groupBy("doc_id", "item_id").agg(
        F.max("words").alias("words"), F.min_by("doc_word", F.struct(-F.col("words"), "doc_word")).alias("doc_word")
    )
