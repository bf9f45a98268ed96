"""Word frequencies, text scores and themes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authorloom.functions.text import tokenize
from authorloom.operators.quantiles import wide_percentiles
from authorloom.operators.ranks import first_by_hash, top_per_group


def exploded_terms(docs: DataFrame, tokens: Column, keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, term, tf, df) rows that add up to term and document counts.

    Every occurrence is one row; the first of a word in its text, in sorted order, counts the text as
    well, so document frequencies need neither a shuffle by document nor rows of their own.
    """
    prepared = docs.select(*keep, F.sort_array(tokens).alias("_tokens"))
    one = F.lit(1)

    def counted(term: Column, i: Column) -> Column:
        again = (i > 0) & (F.get(F.col("_tokens"), i - 1) == term)
        return F.struct(term.alias("term"), one.alias("tf"), F.when(again, 0).otherwise(1).alias("df"))

    return prepared.select(*keep, F.inline(F.transform("_tokens", counted)))


def term_counts(
    docs: DataFrame, groups: Sequence[str] = (), stop_words: Iterable[str] = (), accents: bool = True
) -> DataFrame:
    """Occurrences and texts per term (and group)."""
    rows = exploded_terms(docs, tokenize(F.col("text"), stop_words, accents), groups)
    return rows.groupBy(*groups, "term").agg(F.sum("tf").alias("n"), F.sum("df").alias("n_docs"))


def word_frequencies(
    docs: DataFrame, stop_words: Iterable[str] = (), min_df: int = 10, top: int = 100
) -> DataFrame:
    """Most frequent terms of the corpus among those in ``min_df`` texts or more."""
    counts = term_counts(docs, (), stop_words).where(F.col("n_docs") >= min_df)
    return counts.orderBy(F.desc("n"), "term").limit(top)


def word_frequencies_by_label(
    labelled: DataFrame, stop_words: Iterable[str] = (), min_df: int = 10, top: int = 100
) -> DataFrame:
    """The same for each label with its own vocabulary."""
    counts = term_counts(labelled, ("has_label",), stop_words).where(F.col("n_docs") >= min_df)
    return top_per_group(counts, "has_label", [F.desc("n"), F.col("term")], top)


def sample_per_class(
    labelled: DataFrame, n: int = 5000, seed: int = 22, group: str = "has_label", key: str = "id"
) -> DataFrame:
    """At most ``n`` texts per class, the first in seeded hash order.

    Only keys are ranked; what is broadcast has ``n`` of them per class, and texts stay where they are."""
    known = labelled.where(F.col("text").isNotNull())
    chosen = first_by_hash(known.select(group, key), group, key, n, seed).select(group, key)
    return known.join(F.broadcast(chosen), [group, key], "left_semi").select(*labelled.columns)


Scorer = Callable[[list[str]], pd.DataFrame]


def score_texts(df: DataFrame, scorer: Scorer, labels: Sequence[str], id_col: str = "id") -> DataFrame:
    """(content_id, label, score) from a function of a batch of texts.

    ``scorer`` returns one row per text and one column per label. A model is built
    once per task by a factory: pass the callable that the factory returns.
    """
    names = list(labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = scorer(batch["text"].tolist())[names].reset_index(drop=True)
            scores.insert(0, "content_id", batch["content_id"].to_numpy())
            yield scores

    wide = T.StructType(
        [T.StructField("content_id", T.StringType())] + [T.StructField(n, T.DoubleType()) for n in names]
    )
    texts = df.where(F.col("text").isNotNull()).select(
        F.col(id_col).cast("string").alias("content_id"), "text"
    )
    return texts.mapInPandas(run, wide).unpivot("content_id", names, "label", "score")


def lexicon_scorer(lexicon: dict[str, Iterable[str]]) -> Scorer:
    """Share of a text's words per label; the default where no model is given."""
    terms = {label: frozenset(words) for label, words in lexicon.items()}

    def score(texts: list[str]) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = text.lower().split()
            total = max(len(words), 1)
            rows.append({label: sum(w in known for w in words) / total for label, known in terms.items()})
        return pd.DataFrame(rows, columns=list(terms))

    return score


def median_score_by_class(
    scores: DataFrame, classes: DataFrame, exclude: Sequence[str] = ()
) -> DataFrame:
    """Median score per class and score label; ``classes`` has (content_id, has_label)."""
    wanted = scores.where(~F.col("label").isin(*exclude)) if exclude else scores
    joined = wanted.join(classes.select("content_id", "has_label"), "content_id")
    return wide_percentiles(joined, ["has_label", "label"], "score", {"median_score": 0.5})


def theme_tokens(docs: DataFrame, lexicon: DataFrame, id_col: str = "id") -> DataFrame:
    """Hits per text and category; ``lexicon`` has (category, term)."""
    tokens = docs.select(
        F.col(id_col).alias("content_id"), F.explode(tokenize(F.col("text"))).alias("term")
    )
    return tokens.join(lexicon, "term").groupBy("content_id", "category").agg(
        F.count(F.lit(1)).alias("hits")
    )


def theme_means(labelled: DataFrame, lexicon: DataFrame, top: int = 10) -> DataFrame:
    """Mean share of words per category and class over all texts, best first.

    A text's share is the sum of 1/length over its hits, so weights add up by class
    and term before the lexicon is joined; texts without hits count as zero.
    """
    texts = labelled.where(F.col("text").isNotNull())
    prepared = texts.select("has_label", tokenize(F.col("text")).alias("_tokens"))
    weighted = prepared.select(
        "has_label",
        F.try_divide(F.lit(1.0), F.size("_tokens").cast("double")).alias("w"),
        F.explode("_tokens").alias("term"),
    )
    by_term = weighted.groupBy("has_label", "term").agg(F.sum("w").alias("w"))
    sums = by_term.join(lexicon, "term").groupBy("has_label", "category").agg(F.sum("w").alias("w"))
    sizes = texts.groupBy("has_label").agg(F.count(F.lit(1)).alias("n_texts"))
    means = sums.join(F.broadcast(sizes), "has_label").select(
        "has_label", "category", (F.col("w") / F.col("n_texts")).alias("mean_freq")
    )
    return top_per_group(means, "has_label", [F.desc("mean_freq"), F.col("category")], top)
