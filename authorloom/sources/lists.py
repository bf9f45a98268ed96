"""Small JSON lists: phrases and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_list(spark: SparkSession, path: str) -> DataFrame:
    """(value) rows of one JSON array of strings per file."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.explode(F.from_json("value", "array<string>")).alias("value"))


def phrase_list(spark: SparkSession, path: str) -> list[str]:
    """Phrases on the driver, where they are compiled into one pattern.

    The list is written by hand and its pattern is part of every task.
    """
    return [row["value"] for row in read_json_list(spark, path).collect()]
