"""Queries that write committed tables and streams, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorloom.operators.ingest import author_evidence
from authorloom.plans.catalogue.ingest import _EVIDENCE_SQL, KEY, _code_sql, _items
from authorloom.plans.catalogue.registry import PATTERN, PATTERN_SQL, Inputs, flat_sql, query
from authorloom.session import materialise, new_table_path
from authorloom.sources.committed import CommittedTable
from authorloom.streaming.ingest import fold_evidence, evidence_table, stored_content, stored_users, stream_ingest, upsert_labels

BATCHES = 6


def _in_batches(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("batch", F.pmod(F.crc32(F.col(key).cast("binary")), F.lit(BATCHES)).cast("long"))


@query("committed_content", """
SELECT id, author, type, CAST(crc AS BIGINT) AS n_chars FROM (SELECT id, author, type, length(text) AS crc FROM v_content)
""")
def committed_content(c):
    """Batches that are written, written again, written without a commit, and folded: each row once."""
    content = c.content_with(n_chars=F.length("text").cast("long"))
    rows = materialise(_in_batches(content, "id").select("id", "author", "type", "n_chars", "batch"), "content-lengths")
    table = CommittedTable(c.spark, new_table_path(c.spark, "committed-content"), rows.schema)
    for batch in range(BATCHES):
        own = rows.where(F.col("batch") == batch)
        table.commit(own, batch)
        table.commit(own, batch)
    rows.limit(5).write.parquet(f"{table.path}/commit=99/lost")
    table.compact()
    return table.read().drop("batch")


@query("levelled_users", f"""
WITH {_EVIDENCE_SQL.replace("v_content_run2", "v_content_flagged")}
SELECT author AS id, has_label, first_found_in FROM evidence
""")
def levelled_users(c):
    """Evidence of batches of authors, folded into levels, as users."""
    evidence = materialise(_in_batches(author_evidence(c.flagged), "author"), "evidence")
    root = new_table_path(c.spark, "levelled-users")
    for batch in range(BATCHES):
        upsert_labels(c.spark, root, evidence.where(F.col("batch") == batch), batch)
        evidence_table(c.spark, root).compact(fold_evidence, fan=2)
    return stored_users(c.spark, root)


def _landed(c: Inputs, files: int = 4) -> str:
    """The raw items as listing pages of 100 in some files."""
    items = _items(c)
    child = F.struct(F.struct(*[f for f in items.columns if f != "doc_id"]).alias("data"))
    pages = items.groupBy(F.floor(F.col("doc_id") / 100).alias("page_no")).agg(
        F.to_json(F.struct(F.struct(F.collect_list(child).alias("children")).alias("data"))).alias("page")
    )
    path = new_table_path(c.spark, "landed-pages")
    pages.repartition(files, "page_no").select("page").write.text(path)
    return path


def _streamed(c: Inputs) -> str:
    root = new_table_path(c.spark, "streamed")
    query = stream_ingest(
        c.spark, _landed(c), root, f"{root}/checkpoint", KEY, PATTERN, remember=True, files_per_batch=2
    )
    query.awaitTermination()
    return root


_STREAMED_SQL = f"""
SELECT {_code_sql("id")} AS id, {_code_sql("author")} AS author, kind AS type,
       subreddit_name_prefixed AS subreddit, text,
       regexp_matches(CASE WHEN kind = 'post' THEN title || ' ' || text ELSE text END, {PATTERN_SQL})
       AS has_pattern
FROM (SELECT * EXCLUDE (body), {flat_sql("body")} AS text FROM v_raw WHERE body IS NOT NULL)
WHERE lower(author) NOT IN ('[deleted]', 'automoderator') AND distinguished IS NULL
  AND text NOT IN ('', '[removed]', '[deleted]', '<image>')
"""


@query("stream_content", _STREAMED_SQL)
def stream_content(c):
    """Landed pages through the stream, two files at a time, with bounded state and look-up of older ids."""
    return stored_content(c.spark, _streamed(c)).select("id", "author", "type", "subreddit", "text", "has_pattern")


@query("stream_users", f"SELECT author AS id, bool_or(has_pattern) AS has_label FROM ({_STREAMED_SQL}) GROUP BY author")
def stream_users(c):
    """Labels of the authors that the same stream met."""
    return stored_users(c.spark, _streamed(c)).select("id", "has_label")
