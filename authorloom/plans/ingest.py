"""One batch of listing items on top of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorloom.functions.phrases import PhrasePattern
from authorloom.operators.ingest import author_evidence, build_content, merge_evidence, skip_seen
from authorloom.schemas import CONTENT


def ingest_items(
    items: DataFrame,
    users: DataFrame,
    content: DataFrame,
    key: str,
    pattern: PhrasePattern,
    status: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(all users after the batch, content rows the batch adds).

    Of items whose texts are read (``read_texts``) the content rows have ``text_hash`` in place of ``text``;
    which of several copies of an id stays is told by that hash either way."""
    built = build_content(items, key, pattern, status).drop("media_urls")
    if "text" in built.columns:
        built = built.withColumn("text_hash", F.xxhash64("text"))
    names = ["text_hash" if c == "text" and c not in built.columns else c for c in CONTENT.names]
    told = F.xxhash64(*["text_hash" if c == "text" else c for c in CONTENT.names if c != "id"])
    fresh = skip_seen(built.select(*names, told.alias("_order")), content, "_order")
    evidence = author_evidence(fresh)
    return merge_evidence(users, evidence), fresh.select(*names)
