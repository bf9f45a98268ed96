"""Row filters and text rewriting of the content table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorloom.functions.text import char_count, clean_text, flat_word_count, word_count
from authorloom.operators.skew import evaluate_once


def language_filter(content: DataFrame, keep: str = "en", column: str = "lang") -> DataFrame:
    """Rows in the wanted language, and any row with media."""
    wanted = F.coalesce(F.col(column) == keep, F.lit(False)) & F.col("text").isNotNull()
    return content.where(wanted | F.coalesce("has_media", F.lit(False)))


def rewrite_text(content: DataFrame, greedy: bool = True, strict: bool = False) -> DataFrame:
    """Remove tags, links, mentions, spoiler marks and age notes from the text."""
    return evaluate_once(content, text=clean_text(F.col("text"), greedy, strict))


def drop_empty(content: DataFrame) -> DataFrame:
    """Drop empty texts without media, then rows with any missing value.

    A text that became empty stays when the row has media; a missing text does not.
    """
    media = F.coalesce("has_media", F.lit(False))
    return content.where((F.col("text") != "") | media).dropna("any")


def with_text_counts(content: DataFrame, flat: bool = False) -> DataFrame:
    """Add ``char_count`` and ``word_count``; ``flat`` texts have single blanks, as rewriting leaves them."""
    words = flat_word_count if flat else word_count
    return content.withColumn("char_count", char_count(F.col("text"))).withColumn(
        "word_count", words(F.col("text"))
    )


def refresh_has_media(content: DataFrame, media: DataFrame) -> DataFrame:
    """``has_media`` stays true only where a media row is left."""
    left = media.select(F.col("content_id").alias("id")).distinct().withColumn("_left", F.lit(True))
    before = F.col("has_media") if "has_media" in content.columns else F.lit(False)
    flag = F.coalesce(before, F.lit(False)) & F.coalesce("_left", F.lit(False))
    return content.join(left, "id", "left").withColumn("has_media", flag).drop("_left")
