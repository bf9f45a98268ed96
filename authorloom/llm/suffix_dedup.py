"""Removal of long repeated byte strings with a logarithmic family of sparse suffix indexes.

Every ``length``-byte string contains one anchor: of its ``GRAM``-byte strings the one with
the smallest hash, the leftmost of equal ones. Equal strings have equal anchors at the same
distance, so only suffixes that start at anchors are kept (about one in 170 bytes). The
strings that share an anchor start at consecutive positions, and are kept as one *run*.

A level is a suffix array in the form of a table of runs, ordered by the anchor's fingerprint
and then by that of the whole run, with one row for runs of equal content (its number and
first place). New batches get a level of their own; it is merge-scanned against the existing
levels; levels of equal size are merged into one of the next size. A scan finds

* runs of equal content: every string in them is repeated;
* different runs with an equal anchor: one run of each content is read from its text, its
  strings are sorted within the anchor, and equal neighbours are repeated strings.

Bytes under repeated strings are removed at the end, judged on the input. Anchors that very
many different runs share are compared by a count of string fingerprints over the cluster.
Fingerprints have 128 bits where they decide.

Rules: a null text is empty; texts shorter than ``length`` lose nothing. Matches do not cross
documents. ``doc_id`` names a text; a row that occurs twice repeats all its strings, so both
lose them. Rows without doc_id come back whole and repeat nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from authorloom.llm import shared

LENGTH = 400
GRAM = 64
MANY = 5_000
"""Different runs of one anchor that a task sorts itself; beyond, their strings are counted."""
PLACE_BITS = np.uint64(31)
"""Low bits of a ranked hash that hold its place; the same for all blocks, or ranks would differ."""
RUN = "anchor long, content long, doc_id long, start int, size int"
LEVEL = ("anchor", "content", "n", "doc_id", "start", "size")


def smallest_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in three passes."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, first string, number of strings, anchor, content) of every run.

    Starts count from the beginning of the block."""
    width = length - gram + 1
    empty = tuple(np.empty(0, np.int64) for _ in range(5))
    if len(data) < length:
        return empty
    rolling = shared.RollingHash(data, shared.GRAM_BASE)
    hashes = rolling.windows(gram)
    ranked = (hashes >> PLACE_BITS << PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
    at = smallest_in_window(ranked, width) & np.uint64((1 << int(PLACE_BITS)) - 1)
    whole = np.zeros(len(at), bool)
    sizes = np.diff(offsets)
    long = sizes >= length
    whole[shared.ranges(offsets[:-1][long], sizes[long] - length + 1)] = True
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])
    inner = offsets[1:-1]
    change[inner[inner < len(at)]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(at))
    real = whole[starts]
    starts, ends = starts[real], ends[real]
    text = np.searchsorted(offsets, starts, "right") - 1
    second = shared.RollingHash(data, shared.SECOND_BASE)
    content = second.of(starts, ends + length - 1)
    content += shared.mix(at[starts] - starts.astype(np.uint64) + np.uint64(1))
    return text, starts, ends - starts, hashes[at[starts].astype(np.int64)], content


def anchored_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, content, doc_id, start, size) of every run of every text; one row-wise pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in shared.blocks(batches):
            data, offsets = shared.utf8(block.column("text"))
            text, start, size, anchor, content = runs(data, offsets, length, gram)
            if len(text):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)),
                        pa.array(content.view(np.int64)),
                        block.column("doc_id").take(pa.array(text)),
                        pa.array((start - offsets[text]).astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                    ],
                    ["anchor", "content", "doc_id", "start", "size"],
                )

    return docs.where(F.octet_length("text") >= length).mapInArrow(scan, RUN)


def _first() -> tuple[Column, ...]:
    return (
        F.min("doc_id").alias("doc_id"),
        F.min_by("start", "doc_id").alias("start"),
        F.min("size").alias("size"),
    )


class SuffixIndex:
    """Levels of runs; ``add`` brings a batch and records what now repeats."""

    def __init__(self, spark: SparkSession, length: int = LENGTH, gram: int = GRAM, many: int = MANY):
        self.spark, self.length, self.gram, self.many = spark, length, gram, many
        self.levels: list[tuple[int, DataFrame]] = []  # (batches in it, table)
        self.spans: list[DataFrame] = []  # doc_id, start, size: runs that repeat whole
        self.wanted: list[DataFrame] = []  # anchor, doc_id, start, size, crowded: to be compared

    def add(self, batch: DataFrame) -> None:
        """Scan the runs of a batch (see ``anchored_runs``) against the levels, then store them."""
        # runs of equal content have one size; of one document any start will do
        fresh = batch.groupBy("anchor", "content").agg(F.count("*").alias("n"), *_first())
        scan = fresh.select(*LEVEL, F.lit(True).alias("new"))
        for _, level in self.levels:
            scan = scan.union(level.select(*LEVEL, F.lit(False)))
        alone = F.when(~F.col("new") & (F.col("n") == 1), F.col("doc_id"))
        scan = scan.groupBy("anchor", "content").agg(
            F.sum("n").alias("n"),
            *_first(),
            F.bool_or("new").alias("new"),
            F.max(alone).alias("alone"),
            F.max_by("start", alone).alias("alone_start"),
        )
        scan = shared.stored(scan.sortWithinPartitions("anchor", "content"), "suffix-level")
        repeated = scan.where("new and n > 1")
        self.spans.append(
            batch.join(repeated.select("anchor", "content"), ["anchor", "content"], "left_semi").select(
                "doc_id", "start", "size"
            )
        )
        earlier = repeated.where("alone is not null")
        self.spans.append(earlier.select(F.col("alone").alias("doc_id"), F.col("alone_start").alias("start"), "size"))
        mixed = (
            scan.groupBy("anchor")
            .agg(F.count("*").alias("different"), F.bool_or("new").alias("changed"), F.min("n").alias("fewest"))
            .where("different > 1 and changed and fewest = 1")
        )
        self.wanted.append(
            scan.join(mixed.select("anchor", (F.col("different") > self.many).alias("crowded")), "anchor").select(
                "anchor", "doc_id", "start", "size", "crowded"
            )
        )
        self._store(scan)

    def _store(self, scan: DataFrame) -> None:
        """Keep the new batch; levels of equal size become one of the next size."""
        size = 1
        while self.levels and self.levels[-1][0] == size:
            self.levels.pop()
            size *= 2
        # what is left are larger levels; their part of the scan is not stored twice
        table = scan.select(*LEVEL)
        for _, level in self.levels:
            table = table.join(level.select("anchor", "content", F.lit(1).alias("old")), ["anchor", "content"], "left")
            table = table.where("old is null or n > 1").drop("old")
        self.levels.append((size, table))

    def repeated(self, texts: DataFrame) -> DataFrame:
        """(doc_id, start, end) of bytes under repeated strings; may overlap and repeat."""
        whole = self._all(self.spans).select(
            "doc_id", "start", (F.col("start") + F.col("size") + self.length - 1).alias("end")
        )
        wanted = self._all(self.wanted).groupBy("anchor", "doc_id", "start", "size").agg(
            F.bool_or("crowded").alias("crowded")
        )
        contents = self._contents(wanted, texts)
        few = contents.where("not crowded").drop("crowded")
        few = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
            _sorter(self.length), "doc_id long, start int, end int"
        )
        return whole.union(few).union(self._crowded(contents.where("crowded")))

    @staticmethod
    def _all(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out

    def _contents(self, wanted: DataFrame, texts: DataFrame) -> DataFrame:
        """Adds the bytes of each wanted run; (anchor, crowded, doc_id, start, content)."""
        per_doc = wanted.groupBy("doc_id").agg(
            F.collect_list(F.struct("anchor", "crowded", "start", "size")).alias("wanted")
        )
        length = self.length

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in shared.blocks(batches):
                data, offsets = shared.utf8(block.column("text"))
                raw = data.tobytes()
                lists = block.column("wanted")
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                anchor, crowded, start, size = (c for c in lists.flatten().flatten())
                begin = offsets[row] + start.to_numpy()
                end = begin + size.to_numpy() + length - 1
                pieces = [raw[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [anchor, crowded, block.column("doc_id").take(pa.array(row)), start, pa.array(pieces, pa.binary())],
                    ["anchor", "crowded", "doc_id", "start", "content"],
                )

        return texts.join(per_doc, "doc_id").select("doc_id", "text", "wanted").mapInArrow(
            cut, "anchor long, crowded boolean, doc_id long, start int, content binary"
        )

    def _crowded(self, contents: DataFrame) -> DataFrame:
        """The same for anchors with very many runs: strings are counted by fingerprint."""
        length = self.length

        def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in shared.blocks(batches, "content", 1 << 18):
                row, start, one, two = _fingerprints(block, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), block.column("doc_id").take(pa.array(row)), pa.array(start)],
                    ["one", "two", "doc_id", "start"],
                )

        spread = contents.mapInArrow(strings, "one long, two long, doc_id long, start int")
        twice = spread.groupBy("one", "two").count().where("count > 1")
        return spread.join(twice, ["one", "two"], "left_semi").select(
            "doc_id", "start", (F.col("start") + length).alias("end")
        )


def _fingerprints(block: pa.RecordBatch | pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """(row, start in its document, two fingerprints) of every string of the runs of a block."""
    content = block.column("content")
    data, offsets = shared.utf8(content)
    sizes = np.diff(offsets) - length + 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = shared.ranges(offsets[:-1], sizes)
    one = shared.RollingHash(data, shared.GRAM_BASE).of(at, at + length)
    two = shared.RollingHash(data, shared.SECOND_BASE).of(at, at + length)
    first = block.column("start").to_numpy()
    start = (first[row] + at - offsets[row]).astype(np.int32)
    return row, start, one.view(np.int64), two.view(np.int64)


def _sorter(length: int):
    """Sorts the strings of whole anchors; equal neighbours are repeated."""

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        row, start, one, two = _fingerprints(table, length)
        anchor = table.column("anchor").to_numpy()[row]
        order = np.lexsort((two, one ^ anchor))
        one, two, anchor = one[order], two[order], anchor[order]
        same = (one[1:] == one[:-1]) & (two[1:] == two[:-1]) & (anchor[1:] == anchor[:-1])
        twice = np.zeros(len(row), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        # strings of a run start one after the other, so repeated ones form few stretches
        edge = np.ones(len(row), bool)
        edge[1:] = (row[1:] != row[:-1]) | (twice[1:] != twice[:-1])
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(row)) - 1
        first, last = first[twice[first]], last[twice[first]]
        if len(first):
            ids = table.column("doc_id").combine_chunks().take(pa.array(row[first]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(start[first]), pa.array((start[last] + length).astype(np.int32))],
                ["doc_id", "start", "end"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for block in shared.blocks(batches, "content"):
            anchor = block.column("anchor").to_numpy()
            other = np.flatnonzero(anchor != anchor[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut == 0 and rest and rest[-1].column("anchor")[0].as_py() == anchor[-1]:
                rest.append(block)
                continue
            if cut:
                yield from compare(pa.Table.from_batches([*rest, block.slice(0, cut)]).combine_chunks())
            elif rest:
                yield from compare(pa.Table.from_batches(rest).combine_chunks())
            rest = [block.slice(cut)]
        if rest:
            yield from compare(pa.Table.from_batches(rest).combine_chunks())

    return run


def remove(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) without the bytes of (doc_id, start, end)."""
    per_doc = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return _without(texts.join(per_doc, "doc_id", "left"))


def _without(marked: DataFrame) -> DataFrame:
    """The same for rows (doc_id, text, spans); null spans remove nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in shared.blocks(batches):
            data, offsets = shared.utf8(block.column("text"))
            raw = data.tobytes()
            removed, n_spans, kept = [], [], []
            lists = block.column("spans")
            counts = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())))
            start, end = (c.to_numpy() for c in lists.flatten().flatten())
            for i in range(block.num_rows):
                text = raw[offsets[i] : offsets[i + 1]]
                a, b = shared.merged(start[counts[i] : counts[i + 1]], end[counts[i] : counts[i + 1]])
                removed.append(int((b - a).sum()))
                n_spans.append(len(a))
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array(removed, pa.int64()),
                    pa.array(n_spans, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return marked.select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = 2, many: int = MANY
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every byte under a ``length``-byte string
    that also starts elsewhere is removed.

    The table is brought in as ``batches`` batches, as a growing corpus would be. Levels are
    written to the shared folder while the plan is built. ``doc_id`` is an integer."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # said here for both joins below, so that they share one shuffle of the texts
    texts = every.where("doc_id is not null")
    index = SuffixIndex(spark, length, gram, many)
    found = shared.stored(anchored_runs(texts, length, gram), "suffix-runs")
    for number in range(batches):
        index.add(found.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == number))
    unnamed = every.where("doc_id is null").withColumn(
        "spans", F.lit(None).cast("array<struct<start:int,end:int>>")
    )
    return remove(texts, index.repeated(texts)).union(_without(unnamed))


def digests(result: DataFrame) -> DataFrame:
    """The digest columns of the query: the kept bytes as their SHA-256."""
    return result.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
