"""Author aggregation, threshold sweep and binary metrics.

Everything is keyed by columns such as (experiment_name, dataset), so one plan
evaluates many experiments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authorloom.operators.prefix import sums_before

# The grid from 0.1 to 0.9 in steps of 0.05 as binary floats.
THRESHOLDS = (
    0.1, 0.15000000000000002, 0.20000000000000004, 0.25000000000000006, 0.30000000000000004,
    0.3500000000000001, 0.40000000000000013, 0.45000000000000007, 0.5000000000000001,
    0.5500000000000002, 0.6000000000000002, 0.6500000000000001, 0.7000000000000002,
    0.7500000000000002, 0.8000000000000002, 0.8500000000000002, 0.9000000000000002,
)
DEFAULT_THRESHOLD = 0.5
KEYS = ("experiment_name", "dataset")


def softmax_positive(logits: Column) -> Column:
    """P(true) of a pair of logits, stable for large values."""
    return 1.0 / (1.0 + F.exp(logits[0] - logits[1]))


def logits_to_proba(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Add P(true) and the arg-max class (the first on a tie)."""
    pair = F.col(logits)
    return df.withColumn("proba", softmax_positive(pair)).withColumn(
        "predicted", (pair[1] > pair[0]).cast("int")
    )


def author_mean_proba(
    rows: DataFrame, keys: Sequence[str] = KEYS, digits: int | None = None
) -> DataFrame:
    """(keys, author, true_label, predicted_probability): mean over an author's rows.

    ``digits`` rounds the mean, so that it does not depend on the order of summing.
    """
    mean = F.avg("proba")
    if digits is not None:
        mean = F.round(mean, digits)
    return rows.groupBy(*keys, "author").agg(
        F.bool_or("has_label").alias("true_label"), mean.alias("predicted_probability")
    )


def confusion_counts(df: DataFrame, keys: Sequence[str], truth: Column, guess: Column) -> DataFrame:
    """tn, fp, fn, tp per key."""
    return df.groupBy(*keys).agg(
        F.count_if(~truth & ~guess).alias("tn"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(truth & guess).alias("tp"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def with_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, F1, precision and recall; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return (
        counts.withColumn("accuracy", _share(tp + tn, tn + fp + fn + tp))
        .withColumn("f1", _share(2 * tp, 2 * tp + fp + fn))
        .withColumn("precision", _share(tp, tp + fp))
        .withColumn("recall", _share(tp, tp + fn))
    )


def confusion_text() -> Column:
    """The 2x2 matrix as text: ``[[tn, fp], [fn, tp]]``."""
    return F.format_string("[[%d, %d], [%d, %d]]", "tn", "fp", "fn", "tp")


def roc_auc(df: DataFrame, keys: Sequence[str], truth: str, score: str) -> DataFrame:
    """Exact tie-aware area under the ROC curve of any scores; 0.5 for one class.

    Equal scores are counted first. Negatives below each score are summed over even ranges of scores, so no
    window spans the data, however closely the scores lie.
    """
    keys = list(keys)
    scored = df.where(F.col(score).isNotNull())
    level = scored.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.count_if(F.col(truth)).alias("_pos"), F.count_if(~F.col(truth)).alias("_neg")
    )
    below = sums_before(level, keys, "_s", ["_neg"])
    # counts, twice over, pairs ranked right, with ties as half
    right = F.col("_pos").cast("decimal(19,0)") * (2 * F.col("before__neg") + F.col("_neg")).cast("decimal(19,0)")
    level = below.groupBy(*keys).agg(F.sum(right).alias("_u2"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    pairs = F.col("_pos").cast("double") * F.col("_neg").cast("double")
    area = F.when(pairs > 0, F.col("_u2").cast("double") / (2.0 * pairs)).otherwise(F.lit(0.5))
    return level.select(*keys, area.alias("roc_auc"))


def binary_metrics(
    df: DataFrame, keys: Sequence[str] = KEYS, truth: str = "true_label",
    guess: str = "predicted_label", score: str = "predicted_probability",
) -> DataFrame:
    """Confusion counts, the four metrics and the ROC area per key."""
    counts = confusion_counts(df, keys, F.col(truth), F.col(guess) == 1)
    return with_metrics(counts).join(roc_auc(df, keys, truth, score), list(keys))


def threshold_sweep(
    authors: DataFrame, keys: Sequence[str] = ("experiment_name",), grid: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """Confusion counts and metrics for every threshold of the grid.

    Authors are first counted by how many thresholds their probability reaches (at
    most 18 values by 2 classes per key); only those few rows meet the grid.
    """
    reached = F.lit(0)
    for threshold in grid:
        reached = reached + F.when(F.col("predicted_probability") >= threshold, 1).otherwise(0)
    counted = authors.groupBy(*keys, "true_label", reached.alias("_reached")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    points = F.array(
        *[
            F.struct(F.lit(i + 1).alias("rank"), F.lit(float(t)).alias("threshold"))
            for i, t in enumerate(grid)
        ]
    )
    spread = counted.withColumn("_g", F.explode(points))
    guess, truth = F.col("_reached") >= F.col("_g.rank"), F.col("true_label")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("_n")).otherwise(0))

    counts = spread.groupBy(*keys, F.col("_g.threshold").alias("threshold")).agg(
        total(~truth & ~guess).alias("tn"),
        total(~truth & guess).alias("fp"),
        total(truth & ~guess).alias("fn"),
        total(truth & guess).alias("tp"),
    )
    return with_metrics(counts)


def best_threshold(sweep: DataFrame, keys: Sequence[str] = ("experiment_name",)) -> DataFrame:
    """Lowest threshold with the highest F1; the default when every F1 is zero.

    With one class only, or no positive F1, the metrics are NULL.
    """
    two_classes = (F.col("tn") + F.col("fp") > 0) & (F.col("fn") + F.col("tp") > 0)
    usable = two_classes & (F.col("f1") > 0)
    row = F.struct("threshold", "accuracy", "f1", "precision", "recall")
    rank = F.struct(F.when(usable, -F.col("f1")).alias("f"), F.col("threshold").alias("t"))
    best = sweep.groupBy(*keys).agg(F.min_by(F.when(usable, row), F.when(usable, rank)).alias("_b"))
    return best.select(
        *keys,
        F.coalesce("_b.threshold", F.lit(DEFAULT_THRESHOLD)).alias("best_threshold"),
        F.col("_b.accuracy").alias("val_accuracy"),
        F.col("_b.f1").alias("val_f1"),
        F.col("_b.precision").alias("val_precision"),
        F.col("_b.recall").alias("val_recall"),
    )


def apply_threshold(authors: DataFrame, best: DataFrame) -> DataFrame:
    """Author predictions of validation and test with the chosen threshold."""
    # One row per experiment on the right.
    chosen = F.broadcast(best.select("experiment_name", "best_threshold"))
    reached = F.col("predicted_probability") >= F.col("best_threshold")
    return authors.join(chosen, "experiment_name").withColumn(
        "predicted_label", reached.cast("int")
    )


def experiment_result(
    authors: DataFrame, experiment_type: str, version: int = 1, grid: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """One 17-column result row per experiment.

    ``authors`` holds (experiment_name, dataset, author, true_label,
    predicted_probability) with datasets ``validation`` and ``test``.
    """
    val = authors.where(F.col("dataset") == "validation")
    best = best_threshold(threshold_sweep(val, grid=grid))
    predicted = apply_threshold(authors, best)
    metrics = binary_metrics(predicted)
    sizes = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    val_side = metrics.where(F.col("dataset") == "validation").select(
        "experiment_name", F.col("roc_auc").alias("_auc"), sizes.alias("num_users_val")
    )
    test_side = metrics.where(F.col("dataset") == "test").select(
        "experiment_name",
        F.col("accuracy").alias("test_accuracy"),
        F.col("f1").alias("test_f1"),
        F.col("precision").alias("test_precision"),
        F.col("recall").alias("test_recall"),
        F.col("roc_auc").alias("test_roc_auc"),
        confusion_text().alias("test_confusion_matrix"),
        sizes.alias("num_users_test"),
    )
    joined = best.join(val_side, "experiment_name").join(test_side, "experiment_name")
    return joined.select(
        F.lit(experiment_type).alias("experiment_type"),
        F.lit(version).alias("version"),
        "experiment_name", "best_threshold",
        "val_accuracy", "val_f1", "val_precision", "val_recall",
        F.when(F.col("val_f1").isNotNull(), F.col("_auc")).alias("val_roc_auc"),
        "test_accuracy", "test_f1", "test_precision", "test_recall", "test_roc_auc",
        "test_confusion_matrix", "num_users_test", "num_users_val",
    )


def author_predictions(predicted: DataFrame) -> DataFrame:
    """The five published columns of author predictions, with the experiment."""
    return predicted.select(
        "experiment_name", "author", F.col("true_label").cast("int").alias("true_label"),
        "predicted_probability", "predicted_label", "dataset",
    )
