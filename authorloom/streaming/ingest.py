"""Listing pages as a stream into committed tables of content, ids and evidence on users.

Every micro-batch commits its content, then the ids it brought, then what it says about its
authors, each under the number of the batch. A batch that is run again after a failure finds what it
has committed and goes on from there; nothing is written twice. Small parts are folded into levels, so
that readers meet a number of files that grows with the logarithm of the batches.

Repeated ids are found in two places. The state of the stream holds the ids of the last ``MEMORY`` of
arrival time and no more (RocksDB, so not in the heap). Older ones are looked up in the table of ids, which is cut by the
hash of the id: only the folders of the hashes in the batch are read, and of those only the id. Any
split of the input into batches ends with the same ids, labels and flags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from authorloom.functions.phrases import PhrasePattern
from authorloom.operators.ingest import author_evidence, build_content, skip_seen
from authorloom.schemas import CONTENT
from authorloom.sources.committed import CommittedTable
from authorloom.sources.listings import stream_listings

BUCKETS = 64
MEMORY = "6 hours"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONTENT_PARTS = T.StructType([*CONTENT.fields, T.StructField("batch", T.LongType())])
_IDS = T.StructType([T.StructField("id", T.StringType()), T.StructField("bucket", T.IntegerType())])
_EVIDENCE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("first_found_in", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("labelled", T.LongType()),
    ]
)
"""Per author the batch that met it first and where, and the first batch that labels it, if any."""


def content_table(spark: SparkSession, root: str) -> CommittedTable:
    return CommittedTable(spark, f"{root}/content", _CONTENT_PARTS)


def id_table(spark: SparkSession, root: str) -> CommittedTable:
    return CommittedTable(spark, f"{root}/ids", _IDS, ("bucket",))


def evidence_table(spark: SparkSession, root: str) -> CommittedTable:
    return CommittedTable(spark, f"{root}/users", _EVIDENCE)


def id_bucket(buckets: int = BUCKETS):
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def stored_content(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Content committed so far; ``before`` leaves out a batch and later ones."""
    rows = content_table(spark, root).read()
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.select(*CONTENT.names)


def fold_evidence(rows: DataFrame) -> DataFrame:
    """One row per author, from which users as of any batch can still be told."""
    return rows.groupBy("id").agg(
        F.min_by("first_found_in", "batch").alias("first_found_in"),
        F.min("batch").alias("batch"),
        F.min("labelled").alias("labelled"),
    )


def stored_users(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Users as all evidence so far gives them, or that of the batches before one.

    A label that was once turned on stays; where an author was found is what the earliest
    batch says."""
    users = fold_evidence(evidence_table(spark, root).read())
    labelled = F.col("labelled").isNotNull()
    if before is not None:
        users = users.where(F.col("batch") < before)
        labelled = F.coalesce(F.col("labelled") < before, F.lit(False))
    return users.select("id", labelled.alias("has_label"), "first_found_in")


def upsert_labels(spark: SparkSession, root: str, evidence: DataFrame, batch: int) -> None:
    """Commit what a batch says about its authors; earlier batches are neither read nor written."""
    said = evidence.select(
        F.col("author").alias("id"),
        "first_found_in",
        F.lit(batch).cast("long").alias("batch"),
        F.when(F.col("has_label"), F.lit(batch)).cast("long").alias("labelled"),
    )
    evidence_table(spark, root).commit(said, batch, f"batch={batch}")


def seen_before(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """(id) of those in ``ids`` (id, bucket) that are stored, reading only the folders of their buckets."""
    touched = [r.bucket for r in ids.select("bucket").distinct().collect()]  # BUCKETS at most
    stored = id_table(spark, root).read().where(F.col("bucket").isin(touched))
    return stored.join(ids, ["bucket", "id"], "left_semi").select("id")


def write_batch(built: DataFrame, batch: int, root: str, look_back: bool = True) -> None:
    """One micro-batch: content not stored by an earlier batch, its ids, then its authors."""
    spark = built.sparkSession
    content, ids = content_table(spark, root), id_table(spark, root)
    if not content.manifest().has(batch):
        keyed = built.withColumn("bucket", id_bucket())
        seen = seen_before(spark, root, keyed.select("id", "bucket")) if look_back else spark.createDataFrame([], "id string")
        fresh = skip_seen(built, seen).withColumn("batch", F.lit(batch).cast("long"))
        content.commit(fresh, batch, f"batch={batch}")
    written = content.rows_of(batch).where(F.col("batch") == batch)
    # one file for each bucket and part
    new_ids = written.select("id", id_bucket().alias("bucket")).repartition("bucket")
    ids.commit(new_ids, batch, f"batch={batch}")
    upsert_labels(spark, root, author_evidence(written), batch)
    ids.compact(lambda rows: rows.repartition("bucket").sortWithinPartitions("bucket", "id"))
    evidence_table(spark, root).compact(fold_evidence)
    content.compact()


def stream_ingest(
    spark: SparkSession,
    source: str,
    root: str,
    checkpoint: str,
    key: str,
    pattern: PhrasePattern,
    remember: bool = False,
    files_per_batch: int | None = None,
    memory: str = MEMORY,
) -> StreamingQuery:
    """Ingest all pages that are there now and stop; run again for later pages.

    With ``remember`` the stream also keeps the ids of the last ``memory`` in its state, which
    drops most repeats before any look-up; state that is older goes. The watermark is on the time of
    arrival, so old content is never late.
    """
    items = stream_listings(spark, source, files_per_batch)
    built = build_content(items, key, pattern).select(*CONTENT.names)
    if remember:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        arrived = built.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", memory)
        built = arrived.dropDuplicatesWithinWatermark(["id"]).drop("arrived")
    return (
        built.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, root))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
