"""Quality score of whole texts: histogram gradient-boosted trees over document statistics.

Features are cut into at most ``BINS`` bins at quantiles of the training sample; trees grow
level by level on bin histograms of gradients; the fitted forest is one set of flat arrays
that a whole block of texts walks in numpy, level by level.

Rules: a null or empty text has all statistics 0 and is scored like any other. Texts are read
whole. Without labels of both classes the score is the base rate (½ without any). Repeated
rows get the same score each; other columns of the input do not enter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorloom.llm import shared
from authorloom.llm.labelled import held_out, labelled_sample

MAX_DOCS = 20_000
BINS = 64
TREES = 80
DEPTH = 4

_LOWER = shared.lower_ascii()
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[9:14] = _NOT_SPACE[32] = False
_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[10] = False


def _classes() -> np.ndarray:
    """Class of each byte: 0 lower, 1 upper, 2 digit, 3 blank, 4 line break, 5 stop or comma,
    6 other ASCII sign, 7 part of another letter."""
    kind = np.full(256, 6, np.uint8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 7
    kind[[32, 9, 11, 12, 13]], kind[10] = 3, 4
    kind[[ord(c) for c in ".,;:"]] = 5
    return kind


_CLASS = _classes()
FEATURES = 24


def _distinct_share(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: share of distinct values, and share of its most frequent value."""
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    runs = np.diff(np.append(at, len(values)))
    distinct = np.bincount(text[at], minlength=len(sizes))
    most = np.zeros(len(sizes))
    np.maximum.at(most, text[at], runs)
    total = np.maximum(sizes, 1)
    return distinct / total, most / total


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` numbers per text."""
    data, offsets = shared.utf8(texts)
    n, sizes = len(texts), np.diff(offsets)
    total = np.maximum(sizes, 1)
    owner = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(owner * 8 + _CLASS[data], minlength=n * 8).reshape(n, 8)
    starts, ends, bounds = shared.words(data, offsets, _NOT_SPACE)
    n_words = np.diff(bounds)
    word_owner = np.repeat(np.arange(n), n_words)
    many = np.maximum(n_words, 1)
    mean = lambda values: np.bincount(word_owner, values, n) / many
    lengths = (ends - starts).astype(float)
    rolling = shared.RollingHash(_LOWER[data], shared.WORD_BASE)
    word = rolling.of(starts, ends)
    distinct, most = _distinct_share(word, bounds)
    pairs = word.copy()
    if len(word):
        pairs[:-1] += shared.mix(word[1:].copy())
    # the last word of a text pairs with the first of the next one, so it is left out
    inner = np.ones(len(word), bool)
    inner[bounds[1:][n_words > 0] - 1] = False
    pair_bounds = np.concatenate(([0], np.cumsum(inner)))[bounds]
    pair_distinct, _ = _distinct_share(pairs[inner], pair_bounds)
    line_starts, line_ends, line_bounds = shared.words(data, offsets, _NOT_BREAK)
    line_distinct, line_most = _distinct_share(rolling.of(line_starts, line_ends), line_bounds)
    n_lines = np.diff(line_bounds)
    last = _CLASS[data[ends - 1]] if len(ends) else np.empty(0, np.uint8)
    first = _CLASS[data[starts]] if len(starts) else np.empty(0, np.uint8)
    columns = [
        np.log1p(sizes),
        np.log1p(n_words),
        *(kinds[:, k] / total for k in range(8)),
        mean(lengths),
        np.sqrt(np.maximum(mean(lengths**2) - mean(lengths) ** 2, 0)),
        mean((last == 6).astype(float)),
        mean((last == 5).astype(float)),
        mean((first == 1).astype(float)),
        mean((first == 6).astype(float)),
        mean((lengths == 1).astype(float)),
        mean((lengths > 20).astype(float)),
        distinct,
        most,
        pair_distinct,
        line_distinct,
        line_most,
        sizes / np.maximum(n_lines, 1),
    ]
    return np.stack(columns, axis=1)


@dataclass(frozen=True)
class Forest:
    """Complete trees in flat arrays: node j of a tree has the children 2j + 1 and 2j + 2."""

    base: float
    feature: np.ndarray  # trees × inner nodes
    cut: np.ndarray  # trees × inner nodes; larger values go right
    value: np.ndarray  # trees × leaves

    def margin(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        depth = int(np.log2(self.value.shape[1]))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (rows[every, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out


def fit(
    rows: np.ndarray,
    labels: np.ndarray,
    trees: int = TREES,
    depth: int = DEPTH,
    rate: float = 0.15,
    smooth: float = 1.0,
    least: float = 5.0,
) -> Forest:
    """Second-order boosting of the log loss on bin histograms; ``least`` rows in a leaf."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    base = float(labels.mean()) if len(labels) else 0.5
    start = float(np.log((base + 0.01) / (1.01 - base)))
    if not len(labels) or base in (0.0, 1.0):
        return Forest(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in rows.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, rows.T, strict=True)], 1)
    n, width = binned.shape
    column = np.arange(width) * BINS
    margin = np.full(n, start)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        grad, hess = chance - labels, chance * (1 - chance)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            flat = ((node - first)[:, None] * (width * BINS) + column + binned).ravel()
            shape = (count, width, BINS)
            g, h, c = (
                np.bincount(flat, None if v is None else np.repeat(v, width), count * width * BINS)
                .reshape(shape)
                .cumsum(axis=2)
                for v in (grad, hess, None)
            )
            G, H, C = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + smooth) + (G - g) ** 2 / (H - h + smooth) - G**2 / (H + smooth)
            gain[(c < least) | (C - c < least)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9:
                    feature[first + k], cut[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (rows[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + smooth)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(cut)
        values.append(value)
    return Forest(start, np.array(features), np.array(thresholds), np.array(values))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Forest:
    """Fit on a bounded labelled sample; only its statistics come to the driver."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in shared.blocks(batches):
            rows = statistics(block.column("text"))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), FEATURES)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("label"), flat.cast(pa.list_(pa.float64()))],
                ["doc_id", "label", "row"],
            )

    shared.small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", max_docs)
    kind = sample.schema["doc_id"].dataType.simpleString()
    table = sample.mapInArrow(extract, f"doc_id {kind}, label int, row array<double>").toArrow()
    table = table.sort_by([("doc_id", "ascending")])
    if table.num_rows == 0:
        return fit(np.empty((0, FEATURES)), np.empty(0))
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("row").chunks])
    return fit(flat.reshape(-1, FEATURES), table.column("label").to_numpy().astype(float))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score): chance of good quality, from the text alone."""
    shared.small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(forest)  # of fixed size: TREES trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in shared.blocks(batches):
            chance = 1 / (1 + np.exp(-model.value.margin(statistics(block.column("text")))))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(chance)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document, predicted at 0.3."""
    return score(docs, train(docs, labels, max_docs)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
