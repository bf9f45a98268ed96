"""Counts looked up for lists of keys in rows, without moving the rows of frequent keys.

At most ``KEYS`` keys can hold a share of 1 / ``KEYS`` or more of all occurrences. Those are
sent to the tasks; all other keys are so rare that none of them can fill a task of a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = 1 << 18
"""Most keys that are ever sent to a task."""


def least_count(total: int, keys: int = KEYS) -> int:
    """Count from which a key is frequent; fewer than ``keys`` + 1 keys of ``total`` occurrences reach it."""
    return max(1, -(-total // keys))


def sum_over_rare(rows: DataFrame, counts: DataFrame, terms: dict) -> DataFrame:
    """Per ``row``, sums over its lists of rare keys, each key met with its row in ``counts``.

    ``rows`` has (row, keys, times) with two lists of the same length; ``counts`` has a column
    ``key`` and others; ``terms`` names the sums, as expressions of ``times`` and the columns of
    ``counts``. Keys without counts meet nulls. Rows without keys have no result.
    """
    pairs = rows.select("row", F.explode(F.arrays_zip("keys", "times")).alias("one"))
    pairs = pairs.select("row", F.col("one.keys").alias("key"), F.col("one.times").alias("times"))
    met = pairs.join(counts, "key", "left")
    return met.groupBy("row").agg(*[F.sum(term).alias(name) for name, term in terms.items()])
