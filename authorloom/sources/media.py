"""Image folders ``<media>/<content id>/<image>`` as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authorloom.sources.media_folders import register


def read_media(spark: SparkSession, folder: str, with_bytes: bool = True) -> DataFrame:
    """(content_id, image, path, length[, content]) of every file.

    Without ``with_bytes`` the files are listed but not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    parts = F.split("path", "/")
    columns = [
        F.element_at(parts, -2).alias("content_id"),
        F.element_at(parts, -1).alias("image"),
        "path",
        "length",
    ]
    return files.select(*columns, *(["content"] if with_bytes else []))


def read_media_folders(
    spark: SparkSession, folder: str, with_bytes: bool = True, prefixes: str | None = None
) -> DataFrame:
    """The same rows, listed by tasks: one for each beginning of the content ids. Filter on ``content_id`` to read
    only some folders."""
    register(spark)
    reader = spark.read.format("media_folders").option("bytes", str(with_bytes).lower())
    if prefixes is not None:
        reader = reader.option("prefixes", prefixes)
    media = reader.load(folder)
    return media if with_bytes else media.drop("content")


def media_file_count(media: DataFrame) -> DataFrame:
    """Number of images."""
    return media.agg(F.count(F.lit(1)).alias("n_images"))
