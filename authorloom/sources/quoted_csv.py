"""Quoted CSV with line breaks in its fields, read by many tasks for each file.

Spark cuts a multi-line CSV file nowhere, because a line break may be part of a field. Here files are
read as lines, which can be cut anywhere. A line begins a record where the quotes before it in the
file are even in number. So a first pass counts the quotes of every split; their running sums say
which splits begin inside a field. A second pass puts the lines of each split together to
records, and the few records that cross a border of splits are put together from their fragments.

Quotes inside fields are doubled, as every writer of quoted CSV does. Each file has a header; columns go
by position. Empty lines are no records. In files whose lines end with \\r\\n that is one line break, in
fields as well. A last field without its closing quote ends with the file. Empty files and folders
without files give no rows.

What comes to the driver is one entry for each split that begins inside a field (about 100 bytes for 128 MB of text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
_RECORDS = "file string, block long, n long, kind string, record string"
OPTIONS = {"quote": QUOTE, "escape": QUOTE, "maxCharsPerColumn": "-1"}


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): lines with the split that they begin in."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def open_splits(lines: DataFrame) -> DataFrame:
    """(file, block) of the splits that begin inside a quoted field: one row for each split is summed up."""
    quotes = lines.groupBy("file", "block").agg(F.sum(F.regexp_count("value", F.lit(QUOTE))).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return quotes.withColumn("before", F.sum("quotes").over(before)).where("before % 2 = 1").select("file", "block")


class _Split:
    """Lines of one split on their way to records."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.inside = file, block, int(inside)
        self.rest: list[str] = []
        self.begun = False
        self.n = 0

    def add(self, lines: pa.Array) -> Iterator[tuple[str, pa.Array]]:
        quotes = pc.count_substring(lines, QUOTE).to_numpy(zero_copy_only=False).astype(np.int64)
        before = (self.inside + np.cumsum(quotes) - quotes) % 2
        self.inside = int(self.inside + quotes.sum()) % 2
        starts = np.flatnonzero(before == 0)
        first = int(starts[0]) if len(starts) else len(lines)
        self.rest += lines[:first].to_pylist()
        if not len(starts):
            return
        yield from self.flush()
        last = int(starts[-1])
        if last > first:
            lists = pa.ListArray.from_arrays(pa.array(starts - first, pa.int32()), lines[first:last])
            yield "whole", pc.binary_join(lists, "\n")
        self.rest, self.begun = lines[last:].to_pylist(), True

    def flush(self, end: bool = False) -> Iterator[tuple[str, pa.Array]]:
        """What is left of a record, as far as this split has it."""
        if self.rest or self.begun:
            kind = ("tail" if end and self.inside else "whole") if self.begun else "head"
            yield kind, pa.array(["\n".join(self.rest)], pa.string())
        self.rest, self.begun = [], False


def fragments(lines: DataFrame, inside: set[tuple[str, int]]) -> DataFrame:
    """(file, block, n, kind, record): whole records, and heads and tails of those that cross a border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: _Split | None = None

        def rows(found: Iterator[tuple[str, pa.Array]]) -> Iterator[pa.RecordBatch]:
            for kind, records in found:
                n = len(records)
                numbers = pa.array(np.arange(split.n, split.n + n))
                split.n += n
                columns = [pa.repeat(split.file, n), pa.repeat(split.block, n), numbers, pa.repeat(kind, n), records]
                yield pa.RecordBatch.from_arrays(columns, ["file", "block", "n", "kind", "record"])

        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch.column("block").to_numpy()
            file = batch.column("file").dictionary_encode()
            place = file.indices.to_numpy()
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (place[1:] != place[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                own = (file.dictionary[int(place[begin])].as_py(), int(blocks[begin]))
                if split is None or own != (split.file, split.block):
                    if split is not None:
                        yield from rows(split.flush(end=True))
                    split = _Split(*own, own in inside)
                yield from rows(split.add(batch.column("value")[begin:end]))
        if split is not None:
            yield from rows(split.flush(end=True))

    return lines.mapInArrow(run, _RECORDS)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, record): every record once, headers among them; (file, block, n) is the order of the files."""
    lines = lines_of(spark, path)
    inside = {(r.file, r.block) for r in open_splits(lines).collect()}
    parts = fragments(lines, inside)
    whole = parts.where("kind = 'whole'").select("file", "block", "n", "record")
    torn = parts.where("kind != 'whole'").withColumn("is_tail", F.col("kind") == "tail")
    so_far = Window.partitionBy("file").orderBy("block", "is_tail").rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct("block", "n")
    owned = torn.withColumn("owner", F.last(F.when(F.col("is_tail"), place), ignorenulls=True).over(so_far))
    mended = owned.groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("block", "is_tail", "record"))).alias("parts")
    )
    # a tail is the first part of its record, whatever else its split has of others
    text = F.concat_ws("\n", F.transform("parts", lambda part: part.record))
    mended = mended.select("file", "owner.block", "owner.n", text.alias("record"))
    return whole.unionByName(mended)


def read_quoted(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All records as string columns, with ``_order``, the place of each in its file."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = records(spark, path)
    crlf = F.col("record").endswith("\r")
    text = F.when(crlf, F.regexp_replace(F.regexp_replace("record", "\r\n", "\n"), "\r$", "")).otherwise(F.col("record"))
    is_header = (F.col("block") == 0) & (F.col("n") == 0)
    body = rows.where(~is_header).withColumn("record", text).where("record != ''")
    parsed = F.from_csv("record", schema, OPTIONS)
    return body.select(F.struct("file", "block", "n").alias("_order"), parsed.alias("row")).select("_order", "row.*")
