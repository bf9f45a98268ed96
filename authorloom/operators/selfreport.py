"""Author labels from self-report phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorloom.functions.phrases import PhrasePattern
from authorloom.operators.skew import evaluate_once


def flag_pattern(content: DataFrame, pattern: PhrasePattern, column: str = "text") -> DataFrame:
    """Set ``has_pattern`` from a search in one column."""
    return evaluate_once(content, has_pattern=pattern.search(F.col(column)))


def relabel(
    users: DataFrame,
    content: DataFrame,
    pattern: PhrasePattern,
    rewrite: bool = False,
    column: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Search again and update both tables; ``rewrite`` forgets earlier flags.

    Content of an unknown author keeps its own flag and touches no user.
    """
    found = pattern.search(F.col(column))
    earlier = F.coalesce("has_pattern", F.lit(False)) if "has_pattern" in content.columns else F.lit(False)
    searched = content.withColumn("_found", found)
    evidence = searched.groupBy(F.col("author").alias("id")).agg(F.bool_or("_found").alias("_found"))
    flag = F.col("_found") if rewrite else earlier | F.col("_found")
    content_out = searched.withColumn("has_pattern", flag).drop("_found")
    hit = F.coalesce("_found", F.lit(False))
    label = hit if rewrite else F.coalesce("has_label", F.lit(False)) | hit
    users_out = users.join(evidence, "id", "left").withColumn("has_label", label).drop("_found")
    return users_out, content_out
