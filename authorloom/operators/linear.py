"""Learned linear text classifier on hashed, weighted word counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorloom.operators.split import TrainConfig
from authorloom.session import materialise


def text_classifier_lr(
    rows: DataFrame,
    config: TrainConfig = TrainConfig("all"),
    features: int = 1 << 16,
    iterations: int = 20,
    regularisation: float = 0.01,
    keep: Sequence[str] = ("id", "author", "has_label", "split"),
) -> DataFrame:
    """Fit on the training split and return P(true) of validation and test rows.

    Word counts are written once; weighting, fitting and predicting read them, not the texts again."""
    prepared = rows.withColumns(
        {"_y": F.col("has_label").cast("double"), "_fit": (F.col("split") == "train") & config.condition()}
    )
    prepared = prepared.where(F.col("_fit") | (F.col("split") != "train"))
    words = RegexTokenizer(inputCol="text", outputCol="_tokens", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2)
    counts = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features)
    counted = counts.transform(words.transform(prepared))
    counted = materialise(counted.select(*dict.fromkeys([*keep, "split", "_y", "_fit", "_tf"])), "word-counts")
    stages = [
        IDF(inputCol="_tf", outputCol="_features", minDocFreq=2),
        LogisticRegression(
            featuresCol="_features", labelCol="_y", maxIter=iterations, regParam=regularisation
        ),
    ]
    model = Pipeline(stages=stages).fit(counted.where("_fit"))
    held_out = counted.where(F.col("split") != "train")
    return model.transform(held_out).select(
        F.lit(config.name).alias("experiment_name"),
        *keep,
        vector_to_array("probability")[1].alias("proba"),
        F.col("prediction").cast("int").alias("predicted"),
    )
