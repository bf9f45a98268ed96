import hashlib
import struct

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from odd_tables import SMALL  # noqa: F401
from authorloom.llm import bpe, catalogue, near_dup, toxicity


def test_stages_apply_in_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SMALL)
        assert at.columns == docs.columns and at.dtypes == docs.dtypes, name
        counts.append(at.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]
    result = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in result} == {r.doc_id for r in at.collect()}
    assert all(r.n_tokens > 0 for r in result if r.decoded_sha256)


def test_first_stage_drops_just_the_rejected(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SMALL).collect()}
    scored = catalogue.QUERIES["op1_toxicity"](spark, SMALL).collect()
    assert kept == {r.doc_id for r in scored if not r.predicted}
    assert toxicity.MAX_DOCS >= 1000


def test_every_number_has_one_query():
    numbers = sorted(int(name.split("_")[0][2:]) for name in catalogue.QUERIES)
    assert numbers == list(range(1, 14))


def test_last_stage_gives_the_ids_of_every_text(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = corpus_pipeline.tokenize(spark, docs, SMALL)
    assert dict(rows.dtypes)["ids"] == "array<int>"
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = {r.doc_id: r.text for r in docs.collect()}
    decoded = {r.doc_id: r.decoded for r in bpe.decode(rows, path, pattern).collect()}
    assert decoded == {i: text or "" for i, text in texts.items()}
    for r in rows.collect():
        digest = hashlib.sha256(struct.pack(f"<{len(r.ids)}I", *r.ids)).hexdigest()
        assert (len(r.ids), digest) == (r.n_tokens, r.ids_sha256)


def test_near_duplicate_stage_links_from_four_fifths(spark):
    """41 of 50 shingles are common, 0.82: under the threshold of op8, above that of the stage."""
    words = [f"w{i}" for i in range(54)]
    near = words[:45]
    docs = spark.createDataFrame(
        [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(near[:20] + ["y"] * 30))],
        "doc_id long, text string",
    )
    assert {r.doc_id for r in near_dup.keep_first(docs).collect()} == {1, 2, 3}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()} == {1, 3}


def test_stages_stand_odd_and_empty_tables(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns named like working columns."""
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
    rows = [
        (None, None, None, 1), (None, "only words without an id here", "x", 2), (1, None, "x", 3), (2, "", None, 4), (3, long, "x", 5),
        (4, "one two three four five six", "x", 6), (4, "one two three four five six", "x", 6), (5, "One two three four five six", "y", 7),
        (6, "password = hunter2hunter2 \U0001f389 \x00 end", "y", 8), (7, " \n\t ", "y", None),
    ]
    given = spark.createDataFrame(rows, "doc_id long, text string, cluster string, component_id long")
    for name in ("lang", "source", "key", "signature", "bands", "label", "score", "weight"):
        given = given.withColumn(name, F.lit("en"))
    given = given.withColumn("n_chars", F.length("text").cast("long"))
    for docs, ids in ((given, [None, None, 1, 2, 3, 4, 6, 7]), (given.where("false"), [])):
        at = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, SMALL)
            assert at.dtypes == docs.dtypes, name
        assert sorted([r.doc_id for r in at.collect()], key=lambda i: -1 if i is None else i) == ids
        last = corpus_pipeline.tokenize(spark, at, SMALL).collect()
        assert len(last) == len(ids)
        assert all("hunter2" not in (r.text or "") for r in at.collect())
