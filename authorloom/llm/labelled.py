"""Bounded samples of labelled documents for the models, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authorloom.llm import shared


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_docs: int) -> DataFrame:
    """(doc_id, text, label): at most ``max_docs`` labelled documents outside the held-out fifth.

    The sample is the first in hash order of doc_id, so it is the same in every run; its
    bound is what makes it fit on the driver and in a broadcast. Labels other than 0 and 1
    are ignored; of repeated labels the larger counts; repeated documents stay.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    chosen = shared.drawn(known, "doc_id", max_docs)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
