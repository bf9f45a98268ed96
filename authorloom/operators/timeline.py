"""Yearly and daily activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authorloom.operators.compare import distinct_days


def _year() -> Column:
    return F.year("timestamp").cast("long")


def yearly_content(content: DataFrame, fill_gaps: bool = False) -> DataFrame:
    """Posts and comments per year; ``fill_gaps`` adds years without content."""
    dated = content.where(F.col("timestamp").isNotNull())
    years = dated.groupBy(_year().alias("year")).agg(
        F.count_if(F.col("type") == "post").alias("n_posts"),
        F.count_if(F.col("type") == "comment").alias("n_comments"),
    )
    if not fill_gaps:
        return years
    span = years.agg(F.min("year").alias("a"), F.max("year").alias("b"))
    every = span.where(F.col("a").isNotNull()).select(F.explode(F.sequence("a", "b")).alias("year"))
    return every.join(years, "year", "left").fillna(0, ["n_posts", "n_comments"])


def _medians_by_year(values: DataFrame, users: DataFrame, value: str, name: str) -> DataFrame:
    """Median over authors per label and year; 0 for a label without authors."""
    labels = users.select(F.col("id").alias("author"), "has_label")
    counted = (
        values.join(labels, "author")
        .groupBy("year", "has_label", value)
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def median(flag: bool) -> Column:
        picked = F.when(F.col("has_label") == flag, F.col(value))
        return F.coalesce(F.percentile(picked, F.lit(0.5), F.col("n")), F.lit(0.0))

    years = counted.groupBy("year").agg(median(True).alias("_t"), median(False).alias("_f"))
    rows = F.array(
        F.struct(F.lit(True).alias("has_label"), F.col("_t").alias(name)),
        F.struct(F.lit(False).alias("has_label"), F.col("_f").alias(name)),
    )
    return years.select("year", F.explode(rows).alias("_r")).select("year", "_r.has_label", f"_r.{name}")


def yearly_median_content(content: DataFrame, users: DataFrame) -> DataFrame:
    """Median items per author by label and year."""
    dated = content.where(F.col("timestamp").isNotNull())
    counts = dated.groupBy("author", _year().alias("year")).agg(F.count("id").alias("items"))
    return _medians_by_year(counts, users, "items", "median_content")


def yearly_median_length(content: DataFrame, users: DataFrame, kind: str) -> DataFrame:
    """Median over authors of their median words per item, by label and year."""
    wanted = content.where((F.col("type") == kind) & F.col("timestamp").isNotNull())
    counted = wanted.groupBy("author", _year().alias("year"), "word_count").agg(
        F.count(F.lit(1)).alias("n")
    )
    medians = counted.repartition("author").groupBy("author", "year").agg(
        F.percentile("word_count", F.lit(0.5), F.col("n")).alias("words")
    )
    return _medians_by_year(medians, users, "words", "median_words")


def activity_ratio(content: DataFrame, users: DataFrame) -> DataFrame:
    """Active days over the days from first to last activity, per author."""
    days = distinct_days(content.where(F.col("timestamp").isNotNull()))
    span = F.datediff("last_day", "first_day") + 1
    ratio = days.select("author", "unique_days", (F.col("unique_days") / span).alias("activity_ratio"))
    return ratio.join(users.select(F.col("id").alias("author"), "has_label"), "author")


def median_daily_content(content: DataFrame, users: DataFrame) -> DataFrame:
    """Median items per active day of every author."""
    daily = (
        content.where(F.col("timestamp").isNotNull())
        .groupBy("author", F.to_date("timestamp").alias("day"))
        .agg(F.count(F.lit(1)).alias("items"))
    )
    medians = daily.groupBy("author").agg(F.median("items").alias("median_daily"))
    return medians.join(users.select(F.col("id").alias("author"), "has_label"), "author")
