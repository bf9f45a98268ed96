import pytest
from pyspark.sql import functions as F

from authorloom.functions.phrases import compile_phrases
from authorloom.operators.ingest import cap_per_author, merge_evidence, new_users, skip_seen, upgrade_label
from authorloom.operators.joins import author_content, drop_orphan_content, known_with_media, label_content
from authorloom.operators.cleaning import refresh_has_media
from authorloom.operators.merge import last_per_id, merge_content, merge_users
from authorloom.operators.selfreport import relabel
from authorloom.operators.words import exploded_terms, sample_per_class
from authorloom.operators.skew import hot_keys, hot_table, skew_join

PATTERN = compile_phrases(["my migraine"], "migraine", ["migraine"])
USERS = "id string, has_label boolean, first_found_in string"
CONTENT = "id string, author string, text string, has_pattern boolean, has_media boolean"


@pytest.fixture
def users(spark):
    return spark.createDataFrame([("a", True, "s1"), ("b", False, "s2"), ("c", False, "s3")], USERS)


@pytest.fixture
def content(spark):
    data = [
        ("1", "a", "nothing", True, False), ("2", "b", "my migraine", False, False),
        ("3", "zz", "my migraine", False, True), ("4", "b", None, None, None),
    ]
    return spark.createDataFrame(data, CONTENT)


def test_relabel_keeps_and_rewrites(users, content, rows):
    kept, flags = relabel(users, content, PATTERN)
    assert rows(kept, "id", "has_label") == [("a", True), ("b", True), ("c", False)]
    assert rows(flags, "id", "has_pattern") == [("1", True), ("2", True), ("3", True), ("4", False)]
    fresh, flags = relabel(users, content, PATTERN, rewrite=True)
    assert rows(fresh, "id", "has_label") == [("a", False), ("b", True), ("c", False)]
    assert rows(flags, "id", "has_pattern") == [("1", False), ("2", True), ("3", True), ("4", False)]


def test_merge_users(spark, users, rows):
    other = spark.createDataFrame([("b", True, "t2"), ("d", False, "t4")], USERS)
    assert rows(merge_users(users, other)) == [
        ("a", True, "s1"), ("b", True, "s2"), ("c", False, "s3"), ("d", False, "t4")
    ]
    empty = users.limit(0)
    assert rows(merge_users(users, empty)) == rows(users)
    assert rows(merge_users(users, users)) == rows(users)


def test_merge_content(spark, content, rows):
    other = spark.createDataFrame(
        [("1", "x", "other", False, True), ("4", "x", "other", True, True), ("9", "x", "new", True, None)], CONTENT
    )
    assert rows(merge_content(content, other)) == [
        ("1", "a", "nothing", True, True), ("2", "b", "my migraine", False, False),
        ("3", "zz", "my migraine", False, True), ("4", "b", None, None, True), ("9", "x", "new", True, False),
    ]


def test_last_per_id(spark, rows):
    df = spark.createDataFrame([("1", "old", 1), ("1", "new", 2), ("2", "only", 3)], "id string, v string, o int")
    assert rows(last_per_id(df, "o")) == [("1", "new"), ("2", "only")]


def test_author_content_is_a_left_join(users, content, rows):
    assert rows(author_content(users, content), "author", "content_id") == [
        ("a", "1"), ("b", "2"), ("b", "4"), ("c", None)
    ]


def test_labels_turn_on_only(spark, users, rows):
    evidence = spark.createDataFrame(
        [("a", False, "n"), ("b", True, "n"), ("x", True, "n")],
        "author string, has_label boolean, first_found_in string",
    )
    assert rows(upgrade_label(users, evidence)) == [("a", True, "s1"), ("b", True, "s2"), ("c", False, "s3")]
    assert rows(new_users(evidence, users)) == [("x", True, "n")]
    both = rows(upgrade_label(users, evidence)) + rows(new_users(evidence, users))
    assert rows(merge_evidence(users, evidence)) == both


def test_skip_seen(spark, rows):
    batch = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b")], "id string, v string")
    stored = spark.createDataFrame([("2",)], "id string")
    assert rows(skip_seen(batch, stored)) == [("1", "a")]


def test_cap_per_author(spark, rows):
    df = spark.createDataFrame(
        [("p1", "a", "post", 1), ("p2", "a", "post", 2), ("p3", "a", "post", 3), ("c1", "a", "comment", 1),
         ("c2", "a", "comment", 2), ("p4", "b", "post", 9)],
        "id string, author string, type string, timestamp int",
    )
    assert rows(cap_per_author(df, 2, 1), "id") == [("c2",), ("p2",), ("p3",), ("p4",)]
    plan = cap_per_author(df)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_gives_the_same_rows(spark, rows, how):
    big = spark.range(3000).select(
        F.concat(F.lit("c"), "id").alias("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("author"),
    )
    keyed = big.select("author").distinct().where("author <> 'k7'").withColumn("v", F.length("author"))
    hot = hot_keys(big, "author", rows=500)
    assert hot == ["hot"]
    salted = skew_join(big, keyed, "author", how, hot, salts=16)
    expected = big.join(keyed, "author", how)
    columns = sorted(expected.columns)
    assert rows(salted, *columns) == rows(expected, *columns)


def test_hot_rows_reach_many_tasks(spark):
    big = spark.range(20000).select(F.col("id").cast("string").alias("id"), F.lit("hot").alias("author"))
    users = spark.createDataFrame([("hot", True, "s")], USERS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = label_content(big, users, ["hot"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 8000
    assert drop_orphan_content(big, users, ["hot"]).count() == 20000


@pytest.fixture
def plain_joins(spark):
    kept = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    for name, value in kept.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_one_author_with_half_of_the_rows(spark, rows, plain_joins, how):
    """Salts by a key's own rows: the same result, and no task with twice the mean."""
    author = F.when(F.col("id") % 2 == 0, "busy").otherwise(F.concat(F.lit("a"), F.col("id") % 997))
    big = spark.range(40_000).select("id", author.alias("author"))
    keyed = big.select("author").distinct().where("author != 'a5'").withColumn("x", F.length("author"))
    hot = hot_table(big, "author")
    assert [r.author for r in hot.collect()] == ["busy"] and hot.first().salts == 64
    assert hot_table(big.where("author != 'busy'"), "author") is None
    joined = skew_join(big, keyed, "author", how, hot)
    assert rows(joined) == rows(big.join(keyed, "author", how))
    if how != "left_anti":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sides = big.join(F.broadcast(hot), "author", "left").count()
        assert sides == 40_000
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
        keyed = keyed.withColumn("wide", F.repeat(F.lit("x"), 200))
        joined = skew_join(big, keyed, "author", how, hot)
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * sum(sizes) / len(sizes), sizes


def test_flags_of_known_content_move_texts_once(spark, rows):
    schema = "id string, author string, text string, has_media boolean"
    content = spark.createDataFrame(
        [("1", "a", "x", True), ("1", "a", "x", True), ("1", "b", "y", True), ("2", "a", "z", True), (None, "a", "n", True),
         ("3", None, "q", True), ("4", "c", "r", False), ("5", "gone", "s", True)], schema)
    users = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    media = spark.createDataFrame([("1",), ("1",), ("4",), ("5",)], "content_id string")
    expected = rows(refresh_has_media(drop_orphan_content(content, users), media), *content.columns)
    kept = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = known_with_media(content, users, media)
        assert rows(got, *content.columns) == expected and len(expected) == 6
        plan = got._jdf.queryExecution().executedPlan()
        lines = [x for x in plan.toString().splitlines()]
        exchanges = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
        with_text = [i for i in exchanges if any("text#" in x for x in lines[i + 1 : i + 3])]
        assert len(exchanges) > 2 and len(with_text) == 1
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def test_sample_moves_no_texts(spark, rows):
    rows_in = [(str(i), i % 3 == 0, f"text {i}" if i % 7 else None) for i in range(200)]
    labelled = spark.createDataFrame(rows_in, "id string, has_label boolean, text string")
    got = sample_per_class(labelled, 10)
    assert got.columns == labelled.columns
    counts = {r.has_label: r["count"] for r in got.groupBy("has_label").count().collect()}
    assert counts == {True: 10, False: 10} and got.where("text is null").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_one_row_for_each_occurrence(spark, rows):
    docs = spark.createDataFrame([(1, "b a b a c a"), (2, ""), (3, None)], "id int, text string")
    found = exploded_terms(docs, F.split("text", " "), ["id"]).where("term != ''")
    assert rows(found) == [(1, "a", 1, 0), (1, "a", 1, 0), (1, "a", 1, 1), (1, "b", 1, 0), (1, "b", 1, 1), (1, "c", 1, 1)]
