"""Group comparison: distributions, box statistics, communities, media."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorloom.operators.quantiles import grouped_percentiles, wide_percentiles


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Row and column count and column names of every table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"),
            "n_rows",
            F.lit(len(df.columns)).cast("long").alias("n_columns"),
            F.lit(",".join(df.columns)).alias("column_names"),
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def head_rows(tables: dict[str, DataFrame], n: int = 5) -> DataFrame:
    """(table_name, row): the first ``n`` rows of every table as JSON, in the order that Spark reads them."""
    parts = [
        df.limit(n).select(F.lit(name).alias("table_name"), F.to_json(F.struct(*df.columns)).alias("row"))
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distribution(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value of one column."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def source_by_label(users: DataFrame) -> DataFrame:
    """Users per first community and label, most labelled first."""
    counts = users.groupBy("first_found_in").agg(
        F.count_if(~F.col("has_label")).alias("n_control"),
        F.count_if(F.col("has_label")).alias("n_label"),
    )
    return counts.orderBy(F.desc("n_label"), "first_found_in")


def content_by_label(profiles: DataFrame) -> DataFrame:
    """Posts, comments and total per label from enriched users."""
    return profiles.groupBy("has_label").agg(
        F.sum("n_posts").alias("n_posts"),
        F.sum("n_comments").alias("n_comments"),
        F.sum(F.col("n_posts") + F.col("n_comments")).alias("n_total"),
    )


def top_communities(content: DataFrame, k: int = 10) -> DataFrame:
    """Communities with the most content."""
    known = content.where(F.col("subreddit").isNotNull())
    return distribution(known, "subreddit").orderBy(F.desc("n"), "subreddit").limit(k)


def with_label_groups(authors: DataFrame) -> DataFrame:
    """Every author twice: in the group ``all`` and in its label's group."""
    own = F.when(F.col("has_label"), F.lit("label")).otherwise(F.lit("control"))
    return authors.withColumn("grp", F.explode(F.array(F.lit("all"), own)))


def box_stats(authors: DataFrame, metrics: Sequence[str], wide: bool = False) -> DataFrame:
    """Box-plot numbers of author-level metrics for all, label and control.

    Quartiles interpolate linearly, whiskers end at the last value within 1.5
    interquartile ranges. ``wide`` is for real-valued metrics with many distinct
    values; counts and lengths use the cheaper default.
    """
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    long = authors.select("has_label", F.explode(pairs).alias("_p")).select(
        "has_label", "_p.metric", "_p.value"
    )
    # Equal values collapse first: the rest works on distinct values only.
    distinct = long.where(F.col("value").isNotNull()).groupBy("metric", "has_label", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    values = with_label_groups(distinct).groupBy("metric", "grp", "value").agg(F.sum("n").alias("n"))
    keys = ["metric", "grp"]
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    if wide:
        quartiles = wide_percentiles(with_label_groups(long), keys, "value", shares)
    else:
        quartiles = values.groupBy(*keys).agg(
            *[F.percentile("value", F.lit(p), F.col("n")).alias(name) for name, p in shares.items()]
        )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    inside = (F.col("value") >= low) & (F.col("value") <= high)
    # One row per metric and group, three groups per metric.
    joined = values.join(F.broadcast(quartiles), keys)
    stats = joined.groupBy(*keys, "q1", "median", "q3").agg(
        F.sum("n").alias("n"),
        F.min(F.when(inside, F.col("value"))).alias("_low"),
        F.max(F.when(inside, F.col("value"))).alias("_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_fliers"),
    )
    return stats.select(
        *keys, "n", "q1", "median", "q3",
        F.least(F.col("_low"), F.col("q1")).alias("whisker_low"),
        F.greatest(F.col("_high"), F.col("q3")).alias("whisker_high"),
        "n_fliers",
    )


def author_median_length(content: DataFrame, users: DataFrame) -> DataFrame:
    """Median characters and words per author and type, with the author's label."""
    counted = content.groupBy("author", "type", "char_count", "word_count").agg(
        F.count(F.lit(1)).alias("n")
    )
    medians = counted.repartition("author", "type").groupBy("author", "type").agg(
        F.percentile("char_count", F.lit(0.5), F.col("n")).alias("median_chars"),
        F.percentile("word_count", F.lit(0.5), F.col("n")).alias("median_words"),
    )
    labels = users.select(F.col("id").alias("author"), "has_label")
    return medians.join(labels, "author", "left")


def media_per_author(content: DataFrame, users: DataFrame) -> DataFrame:
    """Content with media per author that has content, with the label."""
    counts = content.groupBy("author").agg(F.count_if(F.col("has_media")).alias("media_count"))
    return counts.join(users.select(F.col("id").alias("author"), "has_label"), "author")


def community_media_rate(
    content: DataFrame, k: int = 10, min_total: int = 10, prefix: str = "r/"
) -> DataFrame:
    """Communities with the highest share of content that has media."""
    named = content.where(F.col("subreddit").startswith(prefix))
    counts = named.groupBy("subreddit").agg(
        F.count("has_media").alias("total_posts"),
        F.count_if(F.col("has_media")).alias("media_posts"),
    )
    rate = counts.where(F.col("total_posts") >= min_total).withColumn(
        "media_percentage", F.col("media_posts") / F.col("total_posts") * 100
    )
    return rate.orderBy(F.desc("media_percentage"), "subreddit").limit(k)


def audit_counters(media: DataFrame, flagged: DataFrame) -> DataFrame:
    """Images in total and flagged; the flag list may repeat an image."""
    marks = flagged.select("content_id", "image", F.lit(True).alias("_hit")).distinct()
    joined = media.join(marks, ["content_id", "image"], "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total_images"), F.count("_hit").alias("flagged_images")
    )


def distinct_days(content: DataFrame) -> DataFrame:
    """Distinct days with activity and the first and last of them per author."""
    days = content.select("author", F.to_date("timestamp").alias("day")).distinct()
    return days.groupBy("author").agg(
        F.count("day").alias("unique_days"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )


def distinct_labels(labelled: DataFrame) -> DataFrame:
    """Distinct pairs of author and label."""
    return labelled.select("author", "has_label").distinct()


def median_by_group(authors: DataFrame, value: str) -> DataFrame:
    """Median of one author-level count for all, label and control."""
    return grouped_percentiles(with_label_groups(authors), ["grp"], value, {"median": 0.5})
