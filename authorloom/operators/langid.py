"""Language detection from character trigrams (Cavnar and Trenkle 1994).

Profiles are learned from labelled rows by grouping; texts are scored by looking up
their trigrams in the profiles. Every trigram of the whole text counts. Gains are
whole numbers, so sums do not depend on row order. Trigrams are cut and counted as whole
numbers, a block of texts at a time, which costs a fraction of a row for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROFILE_SIZE = 400
SCALE = 1000
POINT_BITS = 21
BLANK = ord(" ")
BLOCK_CHARS = 1 << 20
"""Characters whose trigrams a worker holds at a time."""


@lru_cache(maxsize=1)
def _letters(spark: SparkSession) -> np.ndarray:
    """Code points that are letters to Spark's patterns."""
    points = spark.range(0x110000).where(~F.col("id").between(0xD800, 0xDFFF))
    sign = F.decode(F.unhex(F.lpad(F.hex("id"), 8, F.lit("0"))), "UTF-32")
    found = points.where(sign.rlike(r"^\p{L}$")).toArrow().column("id").to_numpy()
    table = np.zeros(0x110000, bool)
    table[found] = True
    return table


def text_grams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams of all texts, in order; number of each text's) where a trigram is its three code points.

    Pieces overlap; words of letters have one blank between and around them."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(f" {'  '.join(texts)} ".encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    starts = np.cumsum(sizes) - sizes
    letter = letters[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[starts] = True
    points = np.where(letter, points, BLANK)[kept].astype(np.int64)
    sizes = np.add.reduceat(kept, starts, dtype=np.int64)
    ends = np.cumsum(sizes)
    grams = points[:-2] << 2 * POINT_BITS | points[1:-1] << POINT_BITS | points[2:]
    inside = np.ones(len(points), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return grams[inside[:-2]], np.maximum(sizes - 2, 0)


def gram_code(text: str) -> int:
    one, two, three = map(ord, text)
    return one << 2 * POINT_BITS | two << POINT_BITS | three


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows with a text, ``BLOCK_CHARS`` characters at a time or one text that is longer."""
    for batch in batches:
        batch = batch.filter(batch.column("text").is_valid())
        ends = np.cumsum(pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_CHARS, side="right")))
            piece = batch.slice(start, stop - start)
            yield piece, piece.column("text").to_pylist()
            start = stop


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): occurrences of every trigram, counted in blocks of texts before they are shuffled."""

    letters = labelled.sparkSession.sparkContext.broadcast(_letters(labelled.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in _pieces(batches):
            by_lang: dict[str | None, list[str]] = {}
            for name, text in zip(piece.column("lang").to_pylist(), texts):
                by_lang.setdefault(name, []).append(text)
            for name, texts in by_lang.items():
                found, n = np.unique(text_grams(texts, letters.value)[0], return_counts=True)
                columns = [pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

    lower = labelled.select("lang", F.lower("text").alias("text"))
    counted = lower.mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def language_profiles(labelled: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """(lang, gram, gain) of every language's most frequent trigrams.

    ``gain`` is the scaled log of a trigram's share of its profile, in millionths;
    at most ``size`` rows per language.
    """
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # code points are in the order of the texts' bytes
    top = gram_counts(labelled).withColumn("_rank", F.row_number().over(most)).where(F.col("_rank") <= size)
    total = Window.partitionBy("lang")
    share = F.col("n") / F.sum("n").over(total)
    gain = F.round(F.log(share * F.lit(1e6)) * SCALE).cast("long")
    points = [F.shiftright("gram", s).bitwiseAND(F.lit((1 << POINT_BITS) - 1)) for s in (2 * POINT_BITS, POINT_BITS, 0)]
    gram = F.decode(F.unhex(F.concat(*[F.lpad(F.hex(x), 8, "0") for x in points])), "UTF-32")
    return top.select("lang", gram.alias("gram"), gain.alias("gain"))


def detect_language(content: DataFrame, profiles: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, lang) with the highest gain; ties go to the first name in order.

    A text gives one row for each language whose trigrams it has. The profiles have a few
    hundred rows per language; they are collected when the plan is built and sent to every
    worker. Texts without a known trigram are left out.
    """
    known = profiles.select("lang", "gram", "gain").toArrow().to_pylist()
    names = list(dict.fromkeys(r["lang"] for r in known))
    codes = np.unique(np.array([gram_code(r["gram"]) for r in known], np.int64))
    gains, has = np.zeros((len(names), len(codes) + 1), np.int64), np.zeros((len(names), len(codes) + 1), bool)
    for r in known:
        at = names.index(r["lang"]), int(np.searchsorted(codes, gram_code(r["gram"])))
        gains[at], has[at] = r["gain"], True
    spark = content.sparkSession
    model = spark.sparkContext.broadcast((names, pa.array(codes), gains, has, _letters(spark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, codes, gains, has, letters = model.value
        for piece, texts in _pieces(batches):
            grams, sizes = text_grams(texts, letters)
            if not len(grams):
                continue
            # the last place is that of all unknown trigrams
            place = pc.index_in(pa.array(grams), value_set=codes).fill_null(len(codes)).to_numpy()
            rows = np.flatnonzero(sizes)
            firsts = (np.cumsum(sizes) - sizes)[rows]
            for i, name in enumerate(names):
                met = np.logical_or.reduceat(has[i][place], firsts)
                if not met.any():
                    continue
                score = np.add.reduceat(gains[i][place], firsts)[met]
                ids = piece.column(id_col).take(pa.array(rows[met]))
                lang = pa.array([name] * len(score), pa.string())
                yield pa.RecordBatch.from_arrays([ids, lang, pa.array(score)], [id_col, "lang", "score"])

    kind = content.schema[id_col].dataType.simpleString()
    lower = content.select(id_col, F.lower("text").alias("text"))
    scored = lower.mapInArrow(run, f"`{id_col}` {kind}, lang string, score long")
    scored = scored.groupBy(id_col, "lang").agg(F.sum("score").alias("score"))
    best = scored.groupBy(id_col).agg(
        F.min_by("lang", F.struct((-F.col("score")).alias("s"), F.col("lang"))).alias("lang")
    )
    return best


def filter_detected(
    content: DataFrame, profiles: DataFrame, keep: str = "en", id_col: str = "id", texts: DataFrame | None = None
) -> DataFrame:
    """Rows whose detected language is wanted, and any row with media.

    ``texts`` has the texts by id where they are apart from the content, which then needs none."""
    detected = detect_language(content if texts is None else texts, profiles, id_col).where(F.col("lang") == keep)
    wanted = detected.select(id_col, F.lit(True).alias("_wanted"))
    joined = content.join(wanted, id_col, "left")
    return joined.where(
        F.coalesce("_wanted", F.lit(False)) | F.coalesce("has_media", F.lit(False))
    ).drop("_wanted")
