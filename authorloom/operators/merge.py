"""Merging two collection runs and keeping one row per id.

The merges expect one row per id in each run; :func:`last_per_id` makes it so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_per_id(df: DataFrame, order: str, id_col: str = "id") -> DataFrame:
    """One row per id: the last in the given order. Copies collapse map-side."""
    columns = [c for c in df.columns if c not in (id_col, order)]
    last = df.groupBy(id_col).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_row"))
    return last.select(id_col, *[F.col(f"_row.{c}") for c in columns])


def merge_users(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union by id; the first run's columns win and labels are OR-ed."""
    one = first.select("id", F.struct("has_label", "first_found_in").alias("_one"))
    two = second.select("id", F.struct("has_label", "first_found_in").alias("_two"))
    row = F.coalesce("_one", "_two")
    label = F.coalesce("_one.has_label", F.lit(False)) | F.coalesce("_two.has_label", F.lit(False))
    return one.join(two, "id", "full").select(
        "id", label.alias("has_label"), row["first_found_in"].alias("first_found_in")
    )


def merge_content(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union by id; the first run's row wins whole, only ``has_media`` is OR-ed."""
    columns = [c for c in first.columns if c not in ("id", "has_media")]
    fields = [*columns, "has_media"]
    one = first.select("id", F.struct(*fields).alias("_one"))
    two = second.select("id", F.struct(*fields).alias("_two"))
    row = F.coalesce("_one", "_two")
    media = F.coalesce("_one.has_media", F.lit(False)) | F.coalesce("_two.has_media", F.lit(False))
    return one.join(two, "id", "full").select(
        "id", *[row[c].alias(c) for c in columns], media.alias("has_media")
    )
