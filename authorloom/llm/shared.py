"""What the operators share: stored tables, bounded blocks of text and numpy hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authorloom.session import drop_table as drop
from authorloom.session import materialise as stored
from authorloom.session import new_table_path

BLOCK_BYTES = 1 << 19
"""Text that a task holds in numpy arrays at a time; one longer text is a block of its own."""


BATCH_ROWS = 1000
"""Rows that Spark sends to a Python worker at a time; texts may be long, so fewer than its default."""


def small_batches(spark: SparkSession) -> None:
    """Ask for Arrow batches of ``BATCH_ROWS`` rows at most, unless the session has smaller ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


BATCH_BYTES = "16m"
"""Bytes that Spark sends at a time where rows hold large binaries."""


def small_blobs(spark: SparkSession) -> None:
    """Ask for Arrow batches of about ``BATCH_BYTES``, for tables whose rows are large binaries."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Return freed memory to the system, so that an idle worker does not keep what its last task needed."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def drawn(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows that come first in hash order of ``key``, the same in every run.

    Rows are counted first, and only the share of the hash range that holds about twice as
    many is sorted, so that no task sees more than that, however large ``df`` is."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    share = min(1.0, (2 * n + 1000) / max(df.count(), 1))
    return df.where(place < int(share * (1 << 40)) + 1).orderBy(place, key).limit(n)


FILTER_WORDS = 1 << 17
"""Words of 64 bits in a filter of ids; 2 MB, whatever the number of ids."""


def maybe_among(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Adds ``_maybe``: false only where ``key`` is not in ``ids``, decided without moving a row of ``df``.

    One bit for each id. Up to a few million ids nearly all others are told; with many more the filter fills up, and
    whoever reads it has more rows to look at, but never a wrong one."""
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS)).cast("int").alias("_word")
    bit = F.pmod(F.shiftright(F.xxhash64(key), 32), F.lit(64)).cast("int").alias("_bit")
    bits = ids.select(place, bit).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    bits = stored(bits, "filter")  # FILTER_WORDS rows at most
    met = df.withColumns({"_word": place, "_bit": bit}).join(F.broadcast(bits), "_word", "left")
    return met.withColumn("_maybe", F.coalesce(F.expr("getbit(_bits, _bit) = 1"), F.lit(False))).drop("_word", "_bit", "_bits")


def blocks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each piece have about ``limit`` bytes at most."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows gathered to blocks of about ``limit`` bytes and at most 32,768 rows; longer texts are blocks of their own."""
    rest, size, rows = [], 0, 0
    for block in blocks(batches, limit=limit):
        rest.append(block)
        size, rows = size + block.nbytes, rows + block.num_rows
        if size >= limit or rows >= 1 << 15:
            yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            rest, size, rows = [], 0, 0
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, offsets with one entry more than texts)."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on every bit."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, base, np.uint64)
    down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class RollingHash:
    """Polynomial hashes modulo 2**64 of any slices of one sequence; ``base`` is odd."""

    def __init__(self, values: np.ndarray, base: int):
        size = 1 << max(10, int(len(values) + 1).bit_length())
        up, self.down = _powers(base, size)
        terms = values.astype(np.uint64)
        terms += np.uint64(1)
        terms *= up[: len(values)]
        self.sums = np.empty(len(values) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(terms, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends]
        h -= self.sums[starts]
        h *= self.down[starts]
        return mix(h)

    def windows(self, length: int) -> np.ndarray:
        """Hash of every slice of ``length`` values."""
        n = len(self.sums) - length
        if n <= 0:
            return np.empty(0, np.uint64)
        h = self.sums[length:] - self.sums[:n]
        h *= self.down[:n]
        return mix(h)


WORD_BASE = 0x9E3779B97F4A7C15
GRAM_BASE = 0xD1B54A32D192ED03
SECOND_BASE = 0xAEF17502108EF2D9


def lower_ascii() -> np.ndarray:
    """Table that maps bytes A-Z to a-z and all others to themselves."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def words(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets of the words of each text) of the maximal runs of word bytes.

    ``is_word`` says of each of the 256 byte values whether it belongs to words. Words
    do not cross texts.
    """
    inside = is_word[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges: starts[0] … starts[0]+lengths[0]-1, starts[1] …"""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal intervals; touching ones are joined."""
    if len(starts) == 0:
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], starts[1:] > ends[:-1]))
    last = np.concatenate((first[1:], [True]))
    return starts[first], ends[last]
