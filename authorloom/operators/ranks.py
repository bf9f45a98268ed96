"""Ranks and smallest-n samples in hash order, without a global sort.

The hash is uniform, so its leading characters cut every class into even buckets:
bucket sizes give the offset, and only rows of one bucket are ranked together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authorloom.functions.hashing import order_key

RANK_CHARS = 3
SAMPLE_CHARS = 4


def _bucket_offsets(buckets: DataFrame, group: str) -> DataFrame:
    """Rows before each bucket and in total; at most 65,536 rows per class."""
    before = (
        Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    return buckets.select(
        group,
        "_bucket",
        F.col("_n"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(group)).alias("_total"),
    )


def _with_bucket(df: DataFrame, group: str, key: str, seed: int | str, chars: int) -> DataFrame:
    hashed = df.withColumn("_hash", order_key(seed, F.col(key)))
    keyed = hashed.withColumn("_bucket", F.substring("_hash", 1, chars))
    # The joins below ask for this anyway; said here, both readers share one plan.
    return keyed.where(F.col(group).isNotNull() & F.col(key).isNotNull())


def rank_by_hash(df: DataFrame, group: str, key: str, seed: int | str) -> DataFrame:
    """Add ``rank`` (1-based) and ``group_size`` of every row in seeded hash order.

    ``group`` must have few distinct values (a class label).
    """
    keyed = _with_bucket(df, group, key, seed, RANK_CHARS)
    sizes = keyed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = F.broadcast(_bucket_offsets(sizes, group).drop("_n"))
    inside = Window.partitionBy(group, "_bucket").orderBy("_hash", key)
    return (
        keyed.join(offsets, [group, "_bucket"])
        .withColumn("rank", F.col("_before") + F.row_number().over(inside))
        .withColumnRenamed("_total", "group_size")
        .drop("_hash", "_bucket", "_before")
    )


def first_by_hash(df: DataFrame, group: str, key: str, n: int, seed: int | str) -> DataFrame:
    """The ``n`` rows of every class that come first in seeded hash order.

    A first narrow pass counts rows per hash bucket; the second keeps whole buckets
    up to the one holding row ``n`` and ranks only those.
    """
    keyed = _with_bucket(df, group, key, seed, SAMPLE_CHARS)
    sizes = keyed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    needed = F.broadcast(
        _bucket_offsets(sizes, group).where(F.col("_before") < n).select(group, "_bucket", "_before")
    )
    inside = Window.partitionBy(group, "_bucket").orderBy("_hash", key)
    return (
        keyed.join(needed, [group, "_bucket"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(inside))
        .where(F.col("_rank") <= n)
        .drop("_hash", "_bucket", "_before", "_rank")
    )


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int, parts: int = 512) -> DataFrame:
    """The first ``n`` rows of every group in the given order; a NULL group counts as one.

    Groups are first cut to ``n`` rows within hashed parts, so no task sorts a whole group;
    the last step gets ``n * parts`` rows of a group at most.
    """
    whole = Window.partitionBy(group).orderBy(*order)
    split = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    within = Window.partitionBy(group, "_part").orderBy(*order)
    df = split.withColumn("_rank", F.row_number().over(within)).where(F.col("_rank") <= n)
    df = df.drop("_part", "_rank")
    return df.withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= n).drop("_rank")
