"""Author-classification experiments from base table to result rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorloom.operators.answers import author_weighted_share, parse_json_answer, parse_label
from authorloom.operators.bag_of_words import (
    fit_naive_bayes,
    fit_vocab,
    predict_naive_bayes,
    train_terms,
)
from authorloom.operators.evaluation import (
    apply_threshold,
    author_mean_proba,
    author_predictions,
    best_threshold,
    experiment_result,
    threshold_sweep,
)
from authorloom.operators.linear import text_classifier_lr
from authorloom.operators.prompts import PromptTemplate, attach_images, build_prompts, chat_messages
from authorloom.operators.split import (
    TrainConfig,
    experiment_base,
    stratified_author_split,
    with_split,
)
from authorloom.session import materialise

DATASET = {"val": "validation", "test": "test"}


def as_dataset(split: str = "split"):
    """Published name of a split."""
    return F.when(F.col(split) == "val", DATASET["val"]).otherwise(DATASET["test"])


def split_rows(
    users: DataFrame, content: DataFrame, seed: int | str = 22, hot: Sequence[str] | DataFrame | None = ()
) -> DataFrame:
    """Experiment rows with their split; the author-level split is materialised."""
    base = experiment_base(users, content, hot)
    return with_split(base, materialise(stratified_author_split(base, seed)), hot)


def bag_of_words_scores(
    rows: DataFrame,
    configs: Sequence[TrainConfig],
    stop_words: Iterable[str] = (),
    max_features: int = 5000,
    min_df: int = 2,
    max_df: float = 0.95,
) -> DataFrame:
    """P(true) of validation and test texts for every configuration.

    Term counts of all configurations come from one pass and are materialised, since
    each vocabulary reads them; the models are at most a few thousand rows.
    """
    train = rows.where(F.col("split") == "train")
    terms = materialise(train_terms(train, configs, stop_words))
    vocab = fit_vocab(terms, configs, max_features, min_df, max_df)
    model = fit_naive_bayes(vocab)
    held_out = rows.where(F.col("split").isin("val", "test"))
    return predict_naive_bayes(held_out, model, configs, stop_words)


def linear_scores(rows: DataFrame, configs: Sequence[TrainConfig], **options) -> DataFrame:
    """The same columns from the linear classifier, one fit per configuration."""
    parts = [text_classifier_lr(rows, config, **options) for config in configs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def score_experiments(
    scores: DataFrame, experiment_type: str, version: int = 1, digits: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(author predictions, result rows) of scored texts."""
    authors = author_mean_proba(scores.withColumn("dataset", as_dataset()), digits=digits)
    return evaluate_authors(authors, experiment_type, version)


def evaluate_authors(
    authors: DataFrame, experiment_type: str, version: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(author predictions, result rows) of author probabilities.

    Every later step reads the author table, so it is materialised.
    """
    authors = materialise(authors)
    best = best_threshold(threshold_sweep(authors.where(F.col("dataset") == "validation")))
    predictions = author_predictions(apply_threshold(authors, best))
    return predictions, experiment_result(authors, experiment_type, version)


def run_grid(
    rows: DataFrame,
    configs: Sequence[TrainConfig],
    family: str = "bag_of_words",
    version: int = 1,
    digits: int | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """All configurations of a model family: (author predictions, result rows)."""
    scorers: dict[str, Callable[..., DataFrame]] = {
        "bag_of_words": bag_of_words_scores,
        "linear": linear_scores,
    }
    scores = scorers[family](rows, configs, **options)
    return score_experiments(scores, family, version, digits)


def prompt_table(
    rows: DataFrame,
    strategy: str,
    media: DataFrame | None = None,
    template: PromptTemplate = PromptTemplate(),
    examples: DataFrame | None = None,
) -> DataFrame:
    """Validation and test texts as chat messages for an external model."""
    held_out = rows.where(F.col("split").isin("val", "test"))
    prompted = build_prompts(held_out, strategy, template, examples)
    use = media is not None
    return chat_messages(attach_images(prompted, media, use=use))


def evaluate_answers(
    answers: DataFrame,
    confident: bool = False,
    positive: str = "yes",
    negative: str = "no",
    digits: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(author predictions, result rows) of an external model's answers.

    ``answers`` has (experiment_name, split, content_id, author, true_label, answer).
    """
    if confident:
        parsed = parse_json_answer(answers, (positive,), (negative,))
    else:
        parsed = parse_label(answers, positive, negative)
    parsed = parsed.withColumn("dataset", as_dataset())
    authors = author_weighted_share(parsed, ("experiment_name", "dataset"), digits)
    return evaluate_authors(authors, "zero_shot")
