"""Sums over all earlier rows of a group, without a task that holds the group.

Rows are cut into ranges of (keys, value) at sampled borders, which fall within a group and within any
crowd of close values as well. Each range adds up its own rows; the totals of the ranges, one row for each range
and group, give what comes before a range; the rest is a running sum within it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authorloom.session import materialise


def cut_ranges(df: DataFrame, keys: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """Adds ``_range``: rows cut at sampled borders into even ranges in order, as many as shuffle partitions if not said.

    The rows are written to the shared folder, so that the borders are drawn once for all readers."""
    by = [*keys, value]
    ranged = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return materialise(ranged.withColumn("_range", F.spark_partition_id()), "ranges")


def sums_before(
    df: DataFrame, keys: Sequence[str], value: str, amounts: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Adds ``before_<amount>``: the sum of each amount over the rows of the group with a smaller ``value``.

    A value occurs once in a group, as after counting equal values. A NULL value comes first."""
    keys = list(keys)
    cut = cut_ranges(df, keys, value, ranges)
    totals = cut.groupBy(*keys, "_range").agg(*[F.sum(a).alias(a) for a in amounts])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_range", *[F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(f"_off_{a}") for a in amounts])
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    # the ranges stay whole and as even as they were cut, and the window asks for no other order
    rows = cut.repartitionByRange("_range")
    rows = rows.withColumns({f"_in_{a}": F.coalesce(F.sum(a).over(inside), F.lit(0)) for a in amounts})
    on = [rows[k].eqNullSafe(offsets[k]) for k in keys] + [rows["_range"] == offsets["_range"]]
    # one row for each range and group: the number of ranges is that of shuffle partitions
    met = rows.join(F.broadcast(offsets), on)
    before = [(F.col(f"_off_{a}") + F.col(f"_in_{a}")).alias(f"before_{a}") for a in amounts]
    return met.select(*[rows[c] for c in df.columns], *before)
