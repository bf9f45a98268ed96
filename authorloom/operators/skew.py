"""Joining a large table with a keyed one when a few keys are very frequent.

The large table stands on the left, where adaptive execution can split a skewed
partition. Where the frequent keys are known, their rows are salted as well, which
also holds when the join feeds an aggregation on the same key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authorloom.session import materialise

HOT_ROWS = 5_000_000
SALTS = 512
FINE = 8


def hot_keys(table: DataFrame, key: str, rows: int = HOT_ROWS) -> list:
    """All keys with at least ``rows`` rows, the most frequent first.

    A key below ``rows`` rows fits one task, and there are no more hot keys than rows of
    the table divided by ``rows``. Reads the key column only and counts before the
    shuffle; take it from the stored table, not from a derived one.
    """
    counts = table.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") >= rows).orderBy(F.desc("_n"), key)
    return [row[0] for row in hot.collect()]


def hot_table(table: DataFrame, key: str, rows: int | None = None) -> DataFrame | None:
    """(key, salts) of the keys that hold more rows than a task should, or None if there are none.

    A task should hold ``rows`` rows, by default an even share of all. A key gets salts for its own
    number of rows, ``FINE`` for each such share, so that tasks come out even. The keys stay a table, written to the
    shared folder; there are at most as many as shares. Reads the key column only and counts before the shuffle."""
    counts = table.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col(key).isNotNull())
    if rows is None:
        counts = materialise(counts, "key-counts")
        total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        rows = max(1, total // int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = counts.where(F.col("_n") > rows).select(key, F.ceil(F.col("_n") * FINE / rows).cast("int").alias("salts"))
    hot = materialise(hot, "hot-keys")
    return None if hot.isEmpty() else hot


def skew_join(
    big: DataFrame,
    keyed: DataFrame,
    key: str,
    how: str = "inner",
    hot: Sequence | DataFrame | None = (),
    salts: int = SALTS,
    spread_by: str = "id",
) -> DataFrame:
    """Join ``big`` (left) to ``keyed`` on ``key``; ``hot`` keys go to many tasks.

    Rows of a hot key are spread by a hash of ``spread_by``, and only the hot rows
    of ``keyed`` are repeated. ``hot`` is a table with salts of each key (``hot_table``), or a list of keys that
    get ``salts`` each. Supports inner, left, left_semi and left_anti.
    """
    if isinstance(hot, DataFrame):
        own = hot.select(F.col(key), F.col("salts").alias("_salts"))
        many = F.coalesce("_salts", F.lit(1))
        spread = F.pmod(F.xxhash64(spread_by), many).cast("int")
        left = big.join(own, key, "left").withColumn("_salt", spread).drop("_salts")
        right = keyed.join(own, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1)))
        return left.join(right.drop("_salts"), [key, "_salt"], how).drop("_salt")
    hot = list(hot or ())
    if not hot:
        return big.join(keyed, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    spread = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    copies = F.sequence(F.lit(0), F.lit(salts - 1))
    left = big.withColumn("_salt", F.when(is_hot, spread).otherwise(F.lit(0)))
    right = keyed.withColumn("_salt", F.explode(F.when(is_hot, copies).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace costly columns so that later steps read them as values.

    Spark otherwise rewrites every later filter in terms of the expression and runs
    it again for each. A one-row generator ends that rewriting and stays in codegen.
    """
    kept = [c for c in df.columns if c not in columns]
    packed = F.array(F.struct(*[expr.alias(name) for name, expr in columns.items()]))
    order = df.columns + [name for name in columns if name not in df.columns]
    return df.select(*kept, F.inline(packed)).select(*order)
