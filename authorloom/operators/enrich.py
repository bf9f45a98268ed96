"""Per-author activity and length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("comment", "post")
MEASURES = ("char", "word")


def author_counts(content: DataFrame) -> DataFrame:
    """Posts, comments and items per author, zero where there are none."""
    return content.groupBy("author").agg(
        F.count_if(F.col("type") == "post").alias("n_posts"),
        F.count_if(F.col("type") == "comment").alias("n_comments"),
        F.count_if(F.col("type").isin("post", "comment")).alias("n_content"),
    )


def length_histogram(content: DataFrame) -> DataFrame:
    """Items per author, type and pair of lengths, placed by author.

    Counting equal lengths first shrinks a very active author to one row per
    distinct pair, so the move by author carries no hot key; a single exchange of
    counted rows is also smaller than partial percentile buffers would be.
    """
    counted = content.groupBy("author", "type", "char_count", "word_count").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.repartition("author")


def _sample_std(n: Column, total: Column, squares: Column) -> Column:
    variance = (squares - total * total / n) / (n - 1)
    return F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0))))


def length_aggregates() -> list[Column]:
    """Mean, median and sample deviation of both lengths for both types."""
    out = []
    for measure in MEASURES:
        for kind in KINDS:
            weight = F.when(F.col("type") == kind, F.col("n"))
            value = F.col(f"{measure}_count").cast("double")
            n, total = F.sum(weight), F.sum(weight * value)
            squares = F.sum(weight * value * value)
            picked = F.when(F.col("type") == kind, value)
            median = F.percentile(picked, F.lit(0.5), F.col("n"))
            out += [
                F.try_divide(total, n).alias(f"{measure}_mean_{kind}"),
                median.alias(f"{measure}_median_{kind}"),
                _sample_std(n, total, squares).alias(f"{measure}_std_{kind}"),
            ]
    return out


def author_length_stats(content: DataFrame) -> DataFrame:
    """Twelve length statistics per author, NULL where undefined."""
    return length_histogram(content).groupBy("author").agg(*length_aggregates())


def author_profile(content: DataFrame) -> DataFrame:
    """Counts and length statistics of every author from one pass."""
    n = F.col("n")
    posts = F.sum(F.when(F.col("type") == "post", n).otherwise(0))
    comments = F.sum(F.when(F.col("type") == "comment", n).otherwise(0))
    return length_histogram(content).groupBy("author").agg(
        posts.alias("n_posts"),
        comments.alias("n_comments"),
        (posts + comments).alias("n_content"),
        *length_aggregates(),
    )


def enrich_users(users: DataFrame, content: DataFrame) -> DataFrame:
    """Users that have content, with their profile."""
    profile = author_profile(content).withColumnRenamed("author", "id")
    return users.join(profile, "id")
