import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from authorloom.operators.cleaning import drop_empty, language_filter, refresh_has_media, with_text_counts
from authorloom.operators.enrich import author_counts, author_profile
from authorloom.operators.langid import detect_language, language_profiles
from authorloom.plans.curate import clean_corpus, curate
from authorloom.functions.phrases import compile_phrases

NOW = dt.datetime(2020, 1, 1)
SCHEMA = (
    "id string, author string, type string, subreddit string, text string, timestamp timestamp, "
    "has_pattern boolean, has_media boolean, lang string"
)


def item(i, author="a", kind="post", text="two words", media=False, lang="en", sub="r/x", pattern=False):
    return (str(i), author, kind, sub, text, NOW, pattern, media, lang)


def test_empty_rows(spark, rows):
    df = spark.createDataFrame(
        [item(1, text=""), item(2, text="", media=True), item(3, text=None, media=True), item(4), item(5, sub=None)],
        SCHEMA,
    )
    assert rows(drop_empty(df), "id") == [("2",), ("4",)]


def test_language_filter(spark, rows):
    df = spark.createDataFrame(
        [item(1, lang="de"), item(2, lang="de", media=True), item(3), item(4, lang=None), item(5, text=None)], SCHEMA
    )
    assert rows(language_filter(df), "id") == [("2",), ("3",)]


def test_clean_corpus(spark, rows):
    content = spark.createDataFrame(
        [
            item(1, text="see [a](b) u/me  (25 F) now"), item(2, text="[a](b)"), item(3, text="[a](b)", media=True),
            item(4, "b", text=">!!<"), item(5, "nobody"), item(6, lang="fr"),
        ],
        SCHEMA,
    )
    users = spark.createDataFrame([("a", True, "r/x"), ("b", False, "r/y")], "id string, has_label boolean, first_found_in string")
    media = spark.createDataFrame([("9", "image1.png")], "content_id string, image string")
    enriched, cleaned = clean_corpus(users, content, media)
    assert rows(cleaned, "id", "text", "has_media", "word_count") == [("1", "see now", False, 2), ("3", "", False, 0)]
    assert rows(enriched, "id", "n_posts", "n_content", "word_mean_post") == [("a", 2, 2, 1.0)]


def test_profile_matches_plain_statistics(spark):
    lengths = {"post": [1, 5, 5, 9], "comment": [3]}
    data = [
        item(f"{k}{i}", kind=k, text=" ".join(["w"] * n)) for k, ns in lengths.items() for i, n in enumerate(ns)
    ]
    df = with_text_counts(spark.createDataFrame(data, SCHEMA))
    row = author_profile(df).first()
    posts = lengths["post"]
    assert (row.n_posts, row.n_comments, row.n_content) == (4, 1, 5)
    assert row.word_mean_post == pytest.approx(statistics.mean(posts))
    assert row.word_median_post == statistics.median(posts)
    assert row.word_std_post == pytest.approx(statistics.stdev(posts))
    assert row.word_std_comment is None and row.char_std_comment is None
    assert row.word_median_comment == 3


def test_author_without_comments(spark):
    row = author_profile(with_text_counts(spark.createDataFrame([item(1)], SCHEMA))).first()
    assert row.n_comments == 0 and row.char_mean_comment is None
    assert author_counts(spark.createDataFrame([item(1)], SCHEMA)).first().n_comments == 0


def test_refresh_has_media(spark, rows):
    df = spark.createDataFrame([("1", True), ("2", True), ("3", False)], "id string, has_media boolean")
    media = spark.createDataFrame([("1", "a"), ("1", "b"), ("3", "a")], "content_id string, image string")
    assert rows(refresh_has_media(df, media)) == [("1", True), ("2", False), ("3", False)]


def test_rewriting_runs_once(spark):
    """Later filters must read the rewritten text, not repeat the rewriting."""
    df = spark.createDataFrame([item(1)], SCHEMA)
    users = spark.createDataFrame([("a", True, "r/x")], "id string, has_label boolean, first_found_in string")
    plan = clean_corpus(users, df)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("non-?binary") == 2  # both branches of one pattern


def test_enriching_moves_no_text(spark):
    df = spark.createDataFrame([item(1)], SCHEMA)
    users = spark.createDataFrame([("a", True, "r/x")], "id string, has_label boolean, first_found_in string")
    plan = clean_corpus(users, df)[0]._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert not ("SortMergeJoin" in line and "LeftSemi" in line)
    assert "char_count" in plan and plan.count("non-?binary") == 2


def test_language_detection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    train, held_out = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    found = detect_language(held_out, language_profiles(train)).withColumnRenamed("lang", "found")
    joined = held_out.join(found, "id", "left")
    right = joined.where("lang = found").count()
    assert right / joined.count() > 0.97


def test_curate_merges_and_labels(spark, rows):
    users = spark.createDataFrame([("a", False, "r/x")], "id string, has_label boolean, first_found_in string")
    one = spark.createDataFrame([item(1, text="plain words")], SCHEMA)
    two = spark.createDataFrame([item(1, text="other"), item(2, text="so my migraine")], SCHEMA)
    pattern = compile_phrases(["my migraine"], "migraine", ["migraine"])
    enriched, cleaned = curate(((users, one), (users, two)), pattern)
    assert rows(enriched, "id", "has_label", "n_posts") == [("a", True, 2)]
    assert rows(cleaned, "id", "text", "has_pattern") == [("1", "plain words", False), ("2", "so my migraine", True)]
