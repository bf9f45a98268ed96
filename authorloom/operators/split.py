"""Experiment base table and reproducible author splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authorloom.functions.hashing import order_key
from authorloom.functions.text import has_words
from authorloom.operators.joins import label_content
from authorloom.operators.ranks import rank_by_hash

SEED = 22


def experiment_base(users: DataFrame, content: DataFrame, hot: Sequence[str] | DataFrame | None = ()) -> DataFrame:
    """Labelled content without disclosures and without blank texts."""
    open_text = ~F.coalesce("has_pattern", F.lit(False))
    return label_content(content.where(open_text & has_words(F.col("text"))), users, hot)


def stratified_author_split(
    base: DataFrame, seed: int | str = SEED, train: int = 70, val: int = 15, exact: bool = True
) -> DataFrame:
    """(author, has_label, split): 70/15/15 of each class's authors in hash order.

    ``exact`` ranks authors within their class; otherwise the hash itself is cut at
    the shares, which needs no ranking and is off by sampling noise only.
    """
    authors = base.groupBy("author").agg(F.bool_or("has_label").alias("has_label"))
    if exact:
        ranked = rank_by_hash(authors, "has_label", "author", seed)
        position, size = F.col("rank") * 100, F.col("group_size")
        first, second = position <= size * train, position <= size * (train + val)
    else:
        ranked = authors
        leading = F.conv(F.substring(order_key(seed, F.col("author")), 1, 8), 16, 10).cast("double")
        point = leading / float(1 << 32) * 100
        first, second = point < train, point < train + val
    name = F.when(first, "train").when(second, "val").otherwise("test")
    return ranked.select("author", "has_label", name.alias("split"))


def with_split(base: DataFrame, split: DataFrame, hot: Sequence[str] | DataFrame | None = ()) -> DataFrame:
    """Content rows with their author's split; replaces three membership tests."""
    labelled = split.select(F.col("author").alias("id"), "split")
    return label_content(base, labelled, hot)


@dataclass(frozen=True)
class TrainConfig:
    """One experiment: which training rows it may use."""

    name: str
    exclude_sources: Sequence[str] = ()
    min_words: int = 0
    min_content: int = 0

    def condition(self) -> Column:
        keep = F.lit(True)
        if self.exclude_sources:
            source = F.col("first_found_in")
            keep = keep & ~F.coalesce(source.isin(*self.exclude_sources), F.lit(False))
        if self.min_words > 0:
            keep = keep & (F.col("word_count") >= self.min_words)
        if self.min_content > 0:
            keep = keep & (F.col("n_content") >= self.min_content)
        return F.coalesce(keep, F.lit(False))


def train_filter(rows: DataFrame, config: TrainConfig) -> DataFrame:
    """Filter training rows only; validation and test stay whole.

    A limit on content needs the users' ``n_content``, as enriching them gives it."""
    needed = {"first_found_in": config.exclude_sources, "word_count": config.min_words, "n_content": config.min_content}
    missing = [name for name, used in needed.items() if used and name not in rows.columns]
    if missing:
        raise ValueError(f"{config.name} needs {', '.join(missing)}: take cleaned content and enriched users")
    return rows.where((F.col("split") != "train") | config.condition())
