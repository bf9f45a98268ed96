"""Reading model answers and adding them up per author."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authorloom.functions import patterns as P

INVALID = -1


def normalise_answer(answer: Column) -> Column:
    """Stripped and lower-cased, without the word the chat template may leave in."""
    edge = rf"^[{P.SPACE}]+|[{P.SPACE}]+$"
    lowered = F.lower(F.regexp_replace(answer, edge, ""))
    return F.regexp_replace(F.replace(lowered, F.lit("assistant"), F.lit("")), edge, "")


def parse_label(answers: DataFrame, positive: str = "yes", negative: str = "no") -> DataFrame:
    """Exact one-word answers: label 1 or 0 with confidence 1, else -1 with 0."""
    text = normalise_answer(F.col("answer"))
    label = F.when(text == positive, 1).when(text == negative, 0).otherwise(INVALID)
    return answers.withColumn("label", label).withColumn(
        "confidence", F.when(F.col("label") == INVALID, 0.0).otherwise(1.0)
    )


def parse_json_answer(
    answers: DataFrame, positive: Sequence[str] = ("yes",), negative: Sequence[str] = ("no",)
) -> DataFrame:
    """JSON answers: label and confidence from the outermost braces.

    A missing confidence is 0.5; one out of [0, 1] or not a number, an unknown
    label or broken JSON give -1 with confidence 0.
    """
    braces = F.regexp_extract(normalise_answer(F.col("answer")), r"(?s)\{.*\}", 0)
    # Inside an array the parser also notices text that follows the object.
    wrapped = F.try_parse_json(F.concat(F.lit("["), braces, F.lit("]")))
    single = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    parsed = answers.withColumn("_json", F.when(single, wrapped))
    parsed = parsed.withColumn("_given", F.try_variant_get("_json", "$[0].confidence", "variant"))
    parsed = parsed.withColumn("_name", F.try_variant_get("_json", "$[0].label", "string"))
    number = F.schema_of_variant("_given").rlike("^(DECIMAL|DOUBLE|FLOAT|BIGINT|BOOLEAN)")
    value = F.when(number, F.try_variant_get("_json", "$[0].confidence", "double"))
    confidence = F.when(F.col("_given").isNull(), F.lit(0.5)).otherwise(value)
    in_range = F.coalesce((confidence >= 0) & (confidence <= 1), F.lit(False))
    name = F.lower(F.trim(F.coalesce("_name", F.lit(""))))
    label = (
        F.when(in_range & name.isin(*positive), 1)
        .when(in_range & name.isin(*negative), 0)
        .otherwise(INVALID)
    )
    labelled = parsed.withColumn("label", label)
    final = F.when(F.col("label") == INVALID, 0.0).otherwise(confidence)
    return labelled.withColumn("confidence", final).drop("_json", "_given", "_name")


def author_weighted_share(
    predictions: DataFrame, keys: Sequence[str] = (), digits: int | None = None
) -> DataFrame:
    """Confidence-weighted share of positive rows per author; 0.5 without weight."""
    weight = F.sum("confidence")
    share = F.try_divide(F.sum(F.col("label") * F.col("confidence")), weight)
    share = F.coalesce(share, F.lit(0.5))
    if digits is not None:
        share = F.round(share, digits)
    return predictions.groupBy(*keys, "author").agg(
        F.bool_or("true_label").alias("true_label"), share.alias("predicted_probability")
    )
