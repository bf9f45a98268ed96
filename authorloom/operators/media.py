"""Operators on media tables: flags, boxes, survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authorloom.functions.images import structure_ok

IMAGE = ["content_id", "image"]


def orphan_media(media: DataFrame, content: DataFrame) -> DataFrame:
    """Media rows whose content does not exist."""
    return media.join(content.select(F.col("id").alias("content_id")), "content_id", "left_anti")


def prune_media(media: DataFrame, content: DataFrame) -> DataFrame:
    """Media rows whose content exists."""
    return media.join(content.select(F.col("id").alias("content_id")), "content_id", "left_semi")


def drop_flagged_media(media: DataFrame, flags: DataFrame) -> DataFrame:
    """Media rows that are not on the flag list."""
    return media.join(flags.select(*IMAGE), IMAGE, "left_anti")


def flag_nsfw(scores: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Images with a score above the threshold; scores are (…, label, score) rows."""
    hit = (F.col("label") == "nsfw") & (F.col("score") > threshold)
    return scores.groupBy(*IMAGE).agg(F.bool_or(hit).alias("_hit")).where("_hit").select(*IMAGE)


def flag_faces(media: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images with at least one face box."""
    return media.select(*IMAGE).join(boxes.select(*IMAGE), IMAGE, "left_semi")


def clip_boxes(boxes: DataFrame) -> DataFrame:
    """Whole-pixel boxes cut to the image; boxes without area are dropped."""

    def whole(column: str) -> Column:
        return F.col(column).cast("int")

    clipped = (
        boxes.withColumn("x1", F.greatest(whole("x1"), F.lit(0)))
        .withColumn("y1", F.greatest(whole("y1"), F.lit(0)))
        .withColumn("x2", F.least(whole("x2"), F.col("width").cast("int")))
        .withColumn("y2", F.least(whole("y2"), F.col("height").cast("int")))
    )
    return clipped.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def pixelate_plan(media: DataFrame, cell: int = 200) -> DataFrame:
    """Size of the coarse grid an image is reduced to before it is blown up again."""

    def cells(column: str) -> Column:
        return F.greatest(F.lit(1), F.floor(F.col(column) / cell)).cast("long")

    return media.select(
        *IMAGE, cells("width").alias("grid_width"), cells("height").alias("grid_height")
    )


def header_ok(content: Column, length: Column) -> Column:
    """Header test for JPEG, PNG and WebP files; JPEG and PNG must also end well."""
    size = length.cast("int")
    head = F.hex(F.substring(content, 1, 12))
    tail = F.hex(F.substring(content, -12, 12))
    jpeg = head.startswith("FFD8FF") & tail.endswith("FFD9")
    png = head.startswith("89504E470D0A1A0A") & tail.startswith("0000000049454E44")
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    return F.coalesce((size > 24) & (jpeg | png | webp), F.lit(False))


def drop_broken(media: DataFrame, verdict: Column | None = None) -> DataFrame:
    """Readable images only. ``verdict`` replaces the header test, e.g. ``structure_ok`` or a decoder's."""
    ok = header_ok(F.col("content"), F.col("length")) if verdict is None else verdict
    return media.where(ok)


def drop_damaged(media: DataFrame) -> DataFrame:
    """Whole images only: what passes the header test and a walk through the structure of the file."""
    return drop_broken(drop_broken(media), structure_ok(F.col("content")))
