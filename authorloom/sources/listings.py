"""Landed listing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authorloom.schemas import LISTING_PAGE


def flatten_listings(pages: DataFrame) -> DataFrame:
    """One row per item of a page."""
    items = pages.select(F.explode("data.children").alias("child"))
    return items.select("child.data.*")


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON pages, one page per line."""
    return flatten_listings(spark.read.schema(LISTING_PAGE).json(path))


def stream_listings(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same as a stream over a folder that pages are added to."""
    reader = spark.readStream.schema(LISTING_PAGE)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return flatten_listings(reader.json(path))


def pages_from_json(texts: DataFrame, column: str = "page") -> DataFrame:
    """Pages held as JSON text in a column."""
    return texts.select(F.from_json(column, LISTING_PAGE).alias("_p")).select("_p.data")
