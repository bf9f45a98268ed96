"""Connected components of a link table, as joins over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorloom.llm import shared


def components(links: DataFrame) -> DataFrame:
    """(node, component): smallest id reachable from each node of ``links`` (a, b).

    Every round takes the smallest label of the neighbours and then the label of that label,
    which halves the depth of the trees; each round is written to the shared folder and the one before it dropped. Nodes
    without links do not occur. An empty table gives an empty table.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = links.where("a is not null and b is not null").select(F.inline(ways))
    edges = shared.stored(both.where("a != b").distinct(), "links")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component"))
    labels = shared.stored(labels, "labels")
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", "component", F.least("component", "near").alias("lower")
        )
        jump = labels.select(F.col("node").alias("lower"), F.col("component").alias("root"))
        moved = lower.join(jump, "lower").select(
            "node",
            F.least("lower", "root").alias("component"),
            (F.least("lower", "root") < F.col("component")).alias("moved"),
        )
        moved = shared.stored(moved, "labels")
        shared.drop(labels)
        labels = moved
        if moved.where("moved").isEmpty():
            shared.drop(edges)
            return labels.select("node", "component")
