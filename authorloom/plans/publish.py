"""Preparing a corpus for publication."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authorloom.operators.joins import drop_orphan_content, known_with_media
from authorloom.operators.media import IMAGE, clip_boxes, drop_broken, drop_flagged_media, prune_media


@dataclass(frozen=True)
class Published:
    """Tables of a published corpus; ``manifest`` names an action per image."""

    users: DataFrame
    content: DataFrame
    manifest: DataFrame


def media_actions(media: DataFrame, kept: DataFrame, boxes: DataFrame) -> DataFrame:
    """(content_id, image, action, n_boxes): drop, blur or keep every image."""
    blur = clip_boxes(boxes).groupBy(*IMAGE).agg(F.count(F.lit(1)).alias("_boxes"))
    alive = kept.select(*IMAGE, F.lit(True).alias("_kept"))
    joined = media.select(*IMAGE).join(alive, IMAGE, "left").join(blur, IMAGE, "left")
    action = (
        F.when(F.col("_kept").isNull(), F.lit("drop"))
        .when(F.col("_boxes").isNotNull(), F.lit("blur"))
        .otherwise(F.lit("keep"))
    )
    boxes_left = F.when(F.col("_kept").isNotNull(), F.coalesce("_boxes", F.lit(0))).otherwise(F.lit(0))
    return joined.select(*IMAGE, action.alias("action"), boxes_left.alias("n_boxes"))


def publish_corpus(
    users: DataFrame,
    content: DataFrame,
    media: DataFrame,
    flags: DataFrame,
    boxes: DataFrame,
    verdict: Column | None = None,
    drop_empty: bool = False,
    hot: Sequence[str] | DataFrame | None = (),
) -> Published:
    """Remove flagged, broken and orphan media; refresh flags; list blurring.

    ``drop_empty`` also leaves out content that has neither text nor media.
    """
    sound = drop_broken(drop_flagged_media(media, flags), verdict)
    kept = prune_media(sound, drop_orphan_content(content.select("id", "author"), users, hot))
    refreshed = known_with_media(content, users, kept, hot)
    if drop_empty:
        refreshed = refreshed.where((F.col("text") != "") | F.col("has_media"))
    return Published(users, refreshed, media_actions(media, kept, boxes))
