"""Exact percentiles by group with linear interpolation.

``grouped_percentiles`` suits values from a narrow range (counts, lengths, half
counts): equal values are counted first, so a group holds one row per distinct
value. ``wide_percentiles`` suits free real values in a few large groups: counted values are cut
into even ranges and ranked by sums over the ranges before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authorloom.operators.prefix import sums_before


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per group and distinct value, missing values left out."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))


def weighted_percentile(value: Column, share: float, weight: str = "_n") -> Column:
    return F.percentile(value, F.lit(share), F.col(weight))


def grouped_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], many_groups: bool = False
) -> DataFrame:
    """One column per share. ``many_groups`` moves counted rows once by group.

    With as many groups as authors, partial percentile buffers would be larger than
    the counted rows, so those are repartitioned and aggregated in place.
    """
    counted = value_counts(df, keys, value)
    if many_groups:
        counted = counted.repartition(*keys)
    return counted.groupBy(*keys).agg(
        *[weighted_percentile(F.col(value), p).cast("double").alias(name) for name, p in shares.items()]
    )


def wide_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], ranges: int | None = None
) -> DataFrame:
    """Exact percentiles of real values in few, possibly huge, groups, however the values lie.

    What is broadcast has two rows per group and share.
    """
    keys = list(keys)
    known = df.dropna("any", subset=[*keys, value])
    counted = value_counts(known, keys, value).withColumnRenamed(value, "_v")
    placed = sums_before(counted, keys, "_v", ["_n"], ranges).withColumnRenamed("before__n", "_start")
    totals = placed.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    # Every share needs the two order statistics around its position.
    positions = [F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("_total") - 1)).alias("at")) for name, p in shares.items()]
    targets = totals.select(*keys, F.explode(F.array(*positions)).alias("_t")).select(
        *keys,
        F.col("_t.name").alias("_name"),
        F.col("_t.at").alias("_position"),
        F.explode(F.array_distinct(F.array(F.floor("_t.at"), F.ceil("_t.at")))).alias("_rank"),
    )
    hit = (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_n"))
    ends = (
        placed.join(F.broadcast(targets), keys)
        .where(hit)
        .groupBy(*keys, "_name", "_position")
        .agg(F.min("_v").alias("_lower"), F.max("_v").alias("_upper"))
        .withColumn(
            "_q",
            F.col("_lower")
            + (F.col("_upper") - F.col("_lower")) * (F.col("_position") - F.floor("_position")),
        )
    )
    return ends.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in shares]
    )
