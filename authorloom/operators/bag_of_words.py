"""Multinomial naive Bayes over word counts, as joins and sums.

All experiments of a family are counted in one pass over the tokens: each brings a
condition on training rows and gets its own vocabulary and weights. Every text also
counts one empty term, which carries the class totals and, in the model, the prior;
so a text without a known word still meets the model.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authorloom.functions.text import tokenize
from authorloom.operators.split import TrainConfig
from authorloom.operators.words import exploded_terms

ALL_ROWS = TrainConfig("all")
EACH_TEXT = ""


def _tokens(stop_words: Iterable[str]) -> Column:
    return F.concat(tokenize(F.col("text"), stop_words), F.array(F.lit(EACH_TEXT)))


def train_terms(
    train: DataFrame, configs: Sequence[TrainConfig], stop_words: Iterable[str] = ()
) -> DataFrame:
    """(experiment_name, term, tf_0, tf_1, df) of training rows.

    Token rows carry only flags, and counts are combined before the shuffle by term.
    """
    flags = [c.condition().alias(f"use_{i}") for i, c in enumerate(configs)]
    prepared = train.select("has_label", "text", *flags)
    names = ["has_label", *[f"use_{i}" for i in range(len(configs))]]
    rows = exploded_terms(prepared, _tokens(stop_words), names)
    label = F.col("has_label")
    sums, long = [], []
    for i, config in enumerate(configs):
        use = F.col(f"use_{i}")
        sums.append(F.sum(F.when(use & ~label, F.col("tf")).otherwise(0)).alias(f"tf0_{i}"))
        sums.append(F.sum(F.when(use & label, F.col("tf")).otherwise(0)).alias(f"tf1_{i}"))
        sums.append(F.sum(F.when(use, F.col("df")).otherwise(0)).alias(f"df_{i}"))
        long.append(
            F.struct(
                F.lit(config.name).alias("experiment_name"),
                F.col(f"tf0_{i}").alias("tf_0"),
                F.col(f"tf1_{i}").alias("tf_1"),
                F.col(f"df_{i}").alias("df"),
            )
        )
    counted = rows.groupBy("term").agg(*sums)
    return counted.select("term", F.inline(F.array(*long))).where(F.col("df") > 0)


def train_totals(terms: DataFrame) -> DataFrame:
    """(experiment_name, docs_0, docs_1): training texts per class."""
    return terms.where(F.col("term") == EACH_TEXT).select(
        "experiment_name", F.col("tf_0").alias("docs_0"), F.col("tf_1").alias("docs_1")
    )


def fit_vocab(
    terms: DataFrame,
    configs: Sequence[TrainConfig] = (ALL_ROWS,),
    max_features: int = 5000,
    min_df: int = 2,
    max_df: float = 0.95,
) -> DataFrame:
    """The most frequent terms of each experiment within the document-frequency band."""
    # One row per experiment on the right.
    totals = F.broadcast(train_totals(terms))
    fits = (F.col("df") >= min_df) & (
        F.col("df") <= F.lit(max_df) * (F.col("docs_0") + F.col("docs_1"))
    )
    words = terms.where(F.col("term") != EACH_TEXT).withColumn("n", F.col("tf_0") + F.col("tf_1"))
    kept = words.join(totals, "experiment_name").where(fits)
    parts = [
        kept.where(F.col("experiment_name") == c.name).orderBy(F.desc("n"), "term").limit(max_features)
        for c in configs
    ]
    vocab = parts[0]
    for part in parts[1:]:
        vocab = vocab.unionByName(part)
    return vocab.select("experiment_name", "term", "tf_0", "tf_1", "df", "n", "docs_0", "docs_1")


def fit_naive_bayes(vocab: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(experiment_name, term, log_0, log_1); the empty term holds the raw log priors.

    A vocabulary has at most ``max_features`` rows per experiment, so its sums are
    taken by a window.
    """
    every = Window.partitionBy("experiment_name")
    size = F.count(F.lit(1)).over(every)
    docs = F.col("docs_0") + F.col("docs_1")

    def log_share(count: str) -> Column:
        return F.ln((F.col(count) + alpha) / (F.sum(count).over(every) + alpha * size))

    weighted = vocab.select(
        "experiment_name", "term",
        log_share("tf_0").alias("log_0"),
        log_share("tf_1").alias("log_1"),
        F.ln(F.try_divide("docs_0", docs)).alias("prior_0"),
        F.ln(F.try_divide("docs_1", docs)).alias("prior_1"),
        F.row_number().over(every.orderBy("term")).alias("_row"),
    )
    prior = F.struct(
        F.lit(EACH_TEXT).alias("term"), F.col("prior_0").alias("log_0"), F.col("prior_1").alias("log_1")
    )
    word = F.struct("term", "log_0", "log_1")
    rows = F.when(F.col("_row") == 1, F.array(prior, word)).otherwise(F.array(word))
    return weighted.select("experiment_name", F.inline(rows))


def predict_naive_bayes(
    docs: DataFrame,
    model: DataFrame,
    configs: Sequence[TrainConfig] = (ALL_ROWS,),
    stop_words: Iterable[str] = (),
    keep: Sequence[str] = ("id", "author", "has_label", "split"),
) -> DataFrame:
    """Class and P(true) of every text for every experiment.

    The model has at most ``max_features`` terms per experiment, so it is broadcast
    with one weight column each. A text's tokens sum to one row in their task.
    """
    keep = list(keep)
    weights = model.groupBy("term").agg(
        *[
            F.max(F.when(F.col("experiment_name") == c.name, F.col("log_1") - F.col("log_0"))).alias(f"w_{i}")
            for i, c in enumerate(configs)
        ]
    )
    tokens = docs.select(*keep, F.explode(_tokens(stop_words)).alias("term"))
    sums = (
        tokens.join(F.broadcast(weights), "term")
        .groupBy(*keep)
        .agg(*[F.sum(f"w_{i}").alias(f"s_{i}") for i in range(len(configs))])
    )
    rows = F.array(
        *[
            F.struct(F.lit(c.name).alias("experiment_name"), F.col(f"s_{i}").alias("_odds"))
            for i, c in enumerate(configs)
        ]
    )
    return sums.select(*keep, F.inline(rows)).select(
        "experiment_name", *keep,
        (1.0 / (1.0 + F.exp(-F.col("_odds")))).alias("proba"),
        (F.col("_odds") > 0).cast("int").alias("predicted"),
    )
