"""Alignment of two tokenizers' tokens of the same text, and how their ids go together.

Both tokenizers cut a space and the text into tokens; each token has bytes, so each has an end.
Offsets where tokens of both end cut the text into groups. From one group to the next the two
end lists run in parallel at some shift of their indexes. Stretches of groups of one token each
are skipped by comparing slices of the lists at that shift, doubled as long as they are equal and
halved after the first that is not; where the ends part, the two lists are walked to the next common
end, which is one irregular group and sets the shift anew.

Every token of a group is linked with every token of the other kind in it. For each pair of ids
the number of documents that link it is counted over the whole table. Ids of very frequent
pairs are sent to the tasks, all others are joined (see ``frequent``).

Rules: null and empty texts, and texts whose tokens do not spell them exactly, have no tokens: all
numbers are 0 and the digest is ''. Repeated rows are documents of their own. Rows without doc_id
count and are returned. Very long texts are read whole. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorloom.llm import frequent, shared

LINKS = 1 << 21
"""Links of irregular groups that a task expands at a time."""
SPACE = "▁"

_OTHER = re.compile("[^\x00-ɏ -⁯€]")
"""Letters beyond these are left to the tokenizer's own library; its classes may be of another Unicode version."""


def _byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: visible Latin-1 letters stand
    for themselves, the other bytes for the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Spelling:
    """The bytes of every id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[shared.ranges(self.starts[ids], self.lengths[ids])]


class ByteTokens:
    """A byte-level vocabulary file. With ``ranks``, the same vocabulary as a rank file, texts of
    well-known letters are encoded by the faster library; ids are the same."""

    def __init__(self, path: str, ranks: str | None = None):
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        byte = _byte_of_letter()
        known = {i: t for t, i in model["model"]["vocab"].items()}
        special = {t["id"]: t["content"] for t in model.get("added_tokens", [])}
        size = max([*known, *special]) + 1
        tokens = [b""] * size
        for i, token in known.items():
            tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        for i, token in special.items():
            tokens[i] = token.encode()
        self.spelling = Spelling(tokens)
        self.fast = None
        if ranks:
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
            self.fast = tiktoken.Encoding(
                "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and (text.isascii() or not _OTHER.search(text)):
            return self.fast.encode_to_numpy(text).astype(np.int64)
        return np.array(_library(self.path).encode(text, add_special_tokens=False).ids, np.int64)


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


class PieceTokens:
    """A piece vocabulary file; it puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            tokens.append(bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode())
        self.spelling = Spelling(tokens)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(array("i", self.model.encode(text, num_threads=1)), np.int32).astype(np.int64)


@lru_cache(maxsize=2)
def tokenizers(byte_path: str, piece_path: str, ranks: str | None) -> tuple[ByteTokens, PieceTokens]:
    """Both tokenizers, once for each worker."""
    return ByteTokens(byte_path, ranks), PieceTokens(piece_path)


def common_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens of both lists up to each common end; ``a`` and ``b`` are ends in rising order.

    The last ends must be equal."""
    a, b = [*a, -1], [*b, -2]  # so that no stretch goes on past the end
    at_a: list[int] = []
    at_b: list[int] = []
    runs: list[int] = []
    i = j = 0
    n = len(a) - 1
    while i < n:
        x, y = a[i], b[j]
        while x != y:  # an irregular group; the shift of the indexes is j - i from its end on
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        run = 1
        if a[i + 1] == b[j + 1]:
            run = step = 2
            while a[i + run : i + run + step] == b[j + run : j + run + step]:
                run += step
                step += step
            while step > 1:
                step >>= 1
                if a[i + run : i + run + step] == b[j + run : j + run + step]:
                    run += step
        at_a.append(i)
        at_b.append(j)
        runs.append(run)
        i += run
        j += run
    sizes = np.array(runs, np.int64)
    return shared.ranges(np.array(at_a, np.int64) + 1, sizes), shared.ranges(np.array(at_b, np.int64) + 1, sizes)


class Block:
    """Tokens and groups of some texts, one after the other; texts without tokens have none."""

    def __init__(self, texts: list[str | None], a: ByteTokens, b: PieceTokens):
        self.a, self.b = a, b
        ids_a, ids_b, cuts_a, cuts_b, sizes = [], [], [], [], []
        n_a = n_b = 0
        for text in texts:
            one = self._text(text) if text else None
            if one is None:
                sizes.append((0, 0, 0))
                continue
            own_a, own_b, ends_a, ends_b = one
            ids_a.append(own_a)
            ids_b.append(own_b)
            cuts_a.append(ends_a + n_a)
            cuts_b.append(ends_b + n_b)
            sizes.append((len(own_a), len(own_b), len(ends_a)))
            n_a, n_b = n_a + len(own_a), n_b + len(own_b)
        nothing = [np.empty(0, np.int64)]
        self.ids_a, self.ids_b = np.concatenate(ids_a or nothing), np.concatenate(ids_b or nothing)
        self.cuts_a, self.cuts_b = np.concatenate(cuts_a or nothing), np.concatenate(cuts_b or nothing)
        self.sizes = np.array(sizes, np.int64).reshape(-1, 3)
        self.of_a = np.diff(self.cuts_a, prepend=0)
        self.of_b = np.diff(self.cuts_b, prepend=0)
        self.text = np.repeat(np.arange(len(texts)), self.sizes[:, 2])

    def _text(self, text: str) -> tuple | None:
        whole = np.frombuffer((" " + text).encode("utf-8", "surrogatepass"), np.uint8)
        own_a, own_b = self.a.encode(" " + text), self.b.encode(text)
        ends_a = self.a.spelling.lengths[own_a].cumsum()
        ends_b = self.b.spelling.lengths[own_b].cumsum()
        if not len(own_a) or not len(own_b) or ends_a[-1] != len(whole) or ends_b[-1] != len(whole):
            return None
        if not (np.array_equal(self.a.spelling.spell(own_a), whole) and np.array_equal(self.b.spelling.spell(own_b), whole)):
            return None
        return own_a, own_b, *common_ends(ends_a.tolist(), ends_b.tolist())

    def digests(self) -> list[str]:
        """Digest of each text's groups, ids of either kind by commas, kinds by |, groups by ;"""
        group_a = np.repeat(np.arange(len(self.of_a)), self.of_a)
        group_b = np.repeat(np.arange(len(self.of_b)), self.of_b)
        at_a = np.arange(len(self.ids_a)) + (self.cuts_b - self.of_b)[group_a]
        at_b = np.arange(len(self.ids_b)) + self.cuts_a[group_b]
        letters = np.zeros((len(self.ids_a) + len(self.ids_b), _DIGITS + 1), np.uint8)
        table = _decimals(max(self.a.spelling.size, self.b.spelling.size))
        for ids, at, cuts, end in ((self.ids_a, at_a, self.cuts_a, "|"), (self.ids_b, at_b, self.cuts_b, ";")):
            mark = np.full(len(ids), ord(","), np.uint8)
            mark[cuts - 1] = ord(end)
            letters[at, :_DIGITS] = table[ids]
            letters[at, _DIGITS] = mark
        used = letters != 0
        sizes = used.sum(axis=1)
        data = letters[used].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], self.sizes[:, :2].sum(axis=1).cumsum()))]
        return [
            hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else ""
            for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
        ]

    def n_links(self) -> np.ndarray:
        out = np.zeros(len(self.sizes), np.int64)
        np.add.at(out, self.text, self.of_a * self.of_b)
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair of ids, links) of the distinct pairs of each text, in order."""
        size = self.b.spelling.size
        single = (self.of_a == 1) & (self.of_b == 1)
        at = np.flatnonzero(single)
        text = [self.text[at]]
        pair = [self.ids_a[self.cuts_a[at] - 1] * size + self.ids_b[self.cuts_b[at] - 1]]
        times = [np.ones(len(at), np.int64)]
        odd = np.flatnonzero(~single)
        group_a, id_a, n_a = self._distinct(odd, self.cuts_a, self.of_a, self.ids_a, self.a.spelling.size)
        group_b, id_b, n_b = self._distinct(odd, self.cuts_b, self.of_b, self.ids_b, size)
        first = np.searchsorted(group_b, group_a)
        width = np.searchsorted(group_b, group_a, side="right") - first
        total = np.cumsum(width)
        begin = 0
        while begin < len(group_a):
            before = total[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(total, before + LINKS, side="right")))
            part = slice(begin, stop)
            other = shared.ranges(first[part], width[part])
            text.append(self.text[np.repeat(group_a[part], width[part])])
            pair.append(np.repeat(id_a[part], width[part]) * size + id_b[other])
            times.append(np.repeat(n_a[part], width[part]) * n_b[other])
            if sum(map(len, pair)) > 4 * LINKS:
                text, pair, times = ([x] for x in _summed(text, pair, times))
            begin = stop
        return _summed(text, pair, times)

    @staticmethod
    def _distinct(groups, cuts, sizes, ids, most) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, id, occurrences) of the distinct ids of some groups, in order."""
        own = ids[shared.ranges(cuts[groups] - sizes[groups], sizes[groups])]
        keys, n = np.unique(np.repeat(groups, sizes[groups]) * most + own, return_counts=True)
        return keys // most, keys % most, n


def _summed(text: list, pair: list, times: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text, pair, times = np.concatenate(text), np.concatenate(pair), np.concatenate(times)
    most = int(pair.max()) + 1 if len(pair) else 1
    keys, place = np.unique(text * most + pair, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, place, times)
    return keys // most, keys % most, sums


_DIGITS = 7


@lru_cache(maxsize=2)
def _decimals(size: int) -> np.ndarray:
    """Letters of the numbers below ``size``, filled with zeros at the end."""
    out = np.zeros((size, _DIGITS), np.uint8)
    for i in range(size):
        letters = str(i).encode()
        out[i, : len(letters)] = np.frombuffer(letters, np.uint8)
    return out


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def align(
    docs: DataFrame, byte_path: str, piece_path: str, ranks: str | None = None, groups: bool = False
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys, times) for every row.

    ``keys`` are the distinct linked pairs as a_id * pieces + b_id and ``times`` their links. With ``groups`` the tokens
    and their groups are four more columns: a_ids, b_ids, and a_cuts, b_cuts, the numbers of tokens up to the end of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(byte_path, piece_path, ranks)
        for rows in shared.blocks(batches):
            block = Block(rows.column("text").to_pylist(), a, b)
            n_a, n_b, n_groups = block.sizes.T
            text, pair, times = block.pairs()
            width = np.bincount(text, minlength=rows.num_rows)
            columns = {
                "doc_id": rows.column("doc_id"),
                "n_a": pa.array(n_a),
                "n_b": pa.array(n_b),
                "n_groups": pa.array(n_groups),
                "n_links": pa.array(block.n_links()),
                "groups_sha256": pa.array(block.digests(), pa.string()),
                "keys": _lists(pair, width, pa.int64()),
                "times": _lists(times, width, pa.int64()),
            }
            if groups:
                before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
                columns |= {
                    "a_ids": _lists(block.ids_a, n_a, pa.int32()),
                    "b_ids": _lists(block.ids_b, n_b, pa.int32()),
                    "a_cuts": _lists(block.cuts_a - before_a[block.text], n_groups, pa.int32()),
                    "b_cuts": _lists(block.cuts_b - before_b[block.text], n_groups, pa.int32()),
                }
            yield pa.RecordBatch.from_pydict(columns)

    shared.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>" * groups
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
        f" keys array<long>, times array<long>{more}",
    )


def pair_counts(aligned: DataFrame, pieces: int) -> DataFrame:
    """(key, c, best): documents that link each pair of ids, and 1 where no pair of its A id has more, else 0.

    There is one row at most for each pair of ids of the two vocabularies."""
    counts = aligned.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c"))
    counts = shared.stored(counts, "align-pairs").withColumn("a_id", F.expr(f"key div {pieces}"))
    highest = counts.groupBy("a_id").agg(F.max("c").alias("highest"))  # a row for each id of the vocabulary
    both = counts.join(F.broadcast(highest), "a_id")
    return both.select("key", "c", (F.col("c") == F.col("highest")).cast("int").alias("best"))


def alignment(docs: DataFrame, byte_path: str, piece_path: str, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    ``n_best`` are links whose pair is among the most frequent of its A id, ``count_sum`` adds the
    documents of the pair over all links. Alignments and pair counts are written to the shared folder first."""
    spark = docs.sparkSession
    _, b = tokenizers(byte_path, piece_path, ranks)
    aligned = align(docs, byte_path, piece_path, ranks).withColumn("row", F.monotonically_increasing_id())
    aligned = shared.stored(aligned, "align-rows")
    counts = shared.stored(pair_counts(aligned, b.spelling.size), "align-counts")
    least = frequent.least_count(counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    often = counts.where(F.col("c") >= least).toArrow().sort_by("key")  # frequent.KEYS rows at most
    sent = spark.sparkContext.broadcast(tuple(often.column(c).to_numpy() for c in ("key", "c", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, c, best = sent.value
        for batch in batches:
            lists, times = batch.column("keys"), batch.column("times").flatten()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            own, n = lists.flatten(), times.to_numpy()
            asked = own.to_numpy()
            place = np.searchsorted(key, asked)
            known = np.zeros(len(asked), bool)
            inside = place < len(key)
            known[inside] = key[place[inside]] == asked[inside]
            row = np.repeat(np.arange(batch.num_rows), sizes)
            found = place[known]
            best_sum, count_sum = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(best_sum, row[known], n[known] * best[found])
            np.add.at(count_sum, row[known], n[known] * c[found])
            rare = np.bincount(row[~known], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in kept),
                    pa.array(best_sum),
                    pa.array(count_sum),
                    _lists(asked[~known], rare, pa.int64()),
                    _lists(n[~known], rare, pa.int64()),
                ],
                [*kept, "common_best", "common_sum", "keys", "times"],
            )

    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    names = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in kept)
    rows = aligned.select(*kept, "keys", "times").mapInArrow(
        run, f"{names}, common_best long, common_sum long, keys array<long>, times array<long>"
    )
    rare = frequent.sum_over_rare(
        rows,
        counts.where(F.col("c") < least),
        {"rare_best": F.col("times") * F.col("best"), "rare_sum": F.col("times") * F.col("c")},
    )
    return rows.join(rare, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("common_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("common_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
