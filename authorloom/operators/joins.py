"""Joins between users and content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorloom.operators.skew import skew_join


def label_content(content: DataFrame, users: DataFrame, hot: Sequence[str] | DataFrame | None = ()) -> DataFrame:
    """Content of known authors with the author's columns added."""
    return skew_join(content, users.withColumnRenamed("id", "author"), "author", hot=hot)


def author_content(users: DataFrame, content: DataFrame, hot: Sequence[str] | DataFrame | None = ()) -> DataFrame:
    """Left join of users to their content (``content_id`` is the item's id).

    Written as matched rows plus users without content: a very active author can
    then be split, which a left join does not allow on its right side.
    """
    items = content.withColumnRenamed("id", "content_id")
    known = users.withColumnRenamed("id", "author")
    matched = skew_join(items, known, "author", hot=hot, spread_by="content_id")
    silent = known.join(
        content.select("author").distinct(), "author", "left_anti"
    )
    return matched.unionByName(silent, allowMissingColumns=True)


def drop_orphan_content(content: DataFrame, users: DataFrame, hot: Sequence[str] | DataFrame | None = ()) -> DataFrame:
    """Content whose author is known."""
    known = users.select(F.col("id").alias("author"))
    return skew_join(content, known, "author", "left_semi", hot)


def known_with_media(
    content: DataFrame, users: DataFrame, media: DataFrame, hot: Sequence[str] | DataFrame | None = ()
) -> DataFrame:
    """Content whose author is known, with ``has_media`` true only where a media row is left.

    Both are decided on (id, author) alone and meet the rows in one join, so texts move once. A row
    without an id has no media; one without an author is dropped."""
    known = drop_orphan_content(content.select("id", "author").distinct(), users, hot)
    left = media.select(F.col("content_id").alias("id")).distinct().withColumn("_left", F.lit(True))
    found = known.join(left, "id", "left").withColumnsRenamed({"id": "_id", "author": "_author"})
    same = content["id"].eqNullSafe(found["_id"]) & (content["author"] == found["_author"])
    before = F.col("has_media") if "has_media" in content.columns else F.lit(False)
    flag = F.coalesce(before, F.lit(False)) & F.coalesce("_left", F.lit(False))
    return content.join(found, same).withColumn("has_media", flag).drop("_id", "_author", "_left")


def drop_empty_users(users: DataFrame, content: DataFrame) -> DataFrame:
    """Users with at least one content row."""
    active = content.select(F.col("author").alias("id")).distinct()
    return users.join(active, "id", "left_semi")
