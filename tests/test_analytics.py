import datetime as dt
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from authorloom.operators import compare as C
from authorloom.operators import timeline as T
from authorloom.operators import words as W
from authorloom.operators.prefix import cut_ranges, sums_before
from authorloom.operators.quantiles import grouped_percentiles, wide_percentiles
from authorloom.operators.ranks import first_by_hash, rank_by_hash, top_per_group

SHARES = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "low": 0.0, "high": 1.0}


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_wide_percentiles_match_numpy(spark, ranges):
    rng = np.random.default_rng(1)
    data = {"a": rng.random(501), "b": np.repeat(rng.random(7), 20), "c": np.array([0.3]), "d": rng.lognormal(0, 3, 200)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double")
    for row in wide_percentiles(df, ["g"], "v", SHARES, ranges).collect():
        for name, p in SHARES.items():
            assert row[name] == pytest.approx(np.quantile(data[row.g], p), rel=1e-12), (row.g, name)


def crowded(spark, n=20_000):
    """Nine tenths within 1e-12 of each other, and one value far out."""
    rng = np.random.default_rng(3)
    values = np.concatenate([0.7 + rng.random(n * 9 // 10) * 1e-12, rng.random(n // 10), [1e12]])
    values = np.unique(values)
    return values, spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")


def test_even_ranges_of_crowded_values(spark):
    values, df = crowded(spark)
    sizes = [r["count"] for r in cut_ranges(df, ["g"], "v", 16).groupBy("_range").count().collect()]
    assert len(sizes) > 12 and max(sizes) < 2 * sum(sizes) / len(sizes)
    row = wide_percentiles(df, ["g"], "v", SHARES, 16).first()
    assert all(row[name] == pytest.approx(np.quantile(values, p), rel=1e-15) for name, p in SHARES.items())


def test_sums_before(spark):
    rng = np.random.default_rng(5)
    rows = [(None if g == 3 else f"g{g}", float(v), int(n)) for g in range(4) for v, n in enumerate(rng.integers(0, 9, 50 + 40 * g))]
    got = sums_before(spark.createDataFrame(rows, "g string, v double, n long"), ["g"], "v", ["n"], 9).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.before_n == sum(n for g, v, n in rows if g == r.g and v < r.v)
    assert sums_before(spark.createDataFrame([], "g string, v double, n long"), ["g"], "v", ["n"]).count() == 0


def test_grouped_percentiles_match_numpy(spark):
    data = [1, 1, 2, 3, 5, 8, 13]
    df = spark.createDataFrame([("a", v) for v in data] + [("a", None)], "g string, v int")
    for many in (False, True):
        row = grouped_percentiles(df, ["g"], "v", SHARES, many).first()
        assert [row[n] for n in SHARES] == [np.quantile(data, p) for p in SHARES.values()]


def test_no_window_spans_a_group(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), (F.col("id") / 7).alias("v"))
    plan = wide_percentiles(df, ["g"], "v", SHARES)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan


def test_ranks_in_hash_order(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 5 == 0).alias("g"))
    got = rank_by_hash(df, "g", "id", 7)
    for flag, size in ((True, 1000), (False, 4000)):
        part = got.where(F.col("g") == flag)
        ids = [r.id for r in part.orderBy("rank").collect()]
        expected = [r.id for r in df.where(F.col("g") == flag).orderBy(F.sha2(F.concat(F.lit("7:"), "id"), 256)).collect()]
        assert ids == expected
        assert part.agg(F.min("rank"), F.max("rank"), F.max("group_size")).first()[:] == (1, size, size)
        sample = {r.id for r in first_by_hash(df, "g", "id", 37, 7).where(F.col("g") == flag).collect()}
        assert sample == set(expected[:37])
    assert first_by_hash(df, "g", "id", 10**6, 7).count() == 5000


@pytest.mark.parametrize("n", [3, 1500])
def test_top_per_group(spark, n):
    df = spark.range(5000).select("id", (F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"))
    got = sorted(tuple(r) for r in top_per_group(df, "g", [F.desc("v"), F.col("id")], n).collect())
    rows = sorted((tuple(r) for r in df.collect()), key=lambda r: (-r[2], r[0]))
    assert got == sorted(r for g in (0, 1) for r in [r for r in rows if r[1] == g][:n])


def test_box_stats(spark):
    values = {True: [1, 2, 3, 4, 100], False: [5, 6, 7, 8]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "has_label boolean, n int")
    for wide in (False, True):
        got = {r.grp: r for r in C.box_stats(df, ["n"], wide).collect()}
        row = got["label"]
        assert (row.n, row.q1, row["median"], row.q3) == (5, 2.0, 3.0, 4.0)
        assert (row.whisker_low, row.whisker_high, row.n_fliers) == (1.0, 4.0, 1)
        assert got["all"].n == 9 and got["all"]["median"] == 5.0
        assert got["control"].n_fliers == 0


def test_whiskers_never_end_inside_the_box(spark):
    df = spark.createDataFrame([(True, v) for v in (0, 0, 0, 0, 10)] + [(True, 1000)], "has_label boolean, n int")
    row = C.box_stats(df, ["n"]).where("grp = 'all'").first()
    values = np.array([0, 0, 0, 0, 10, 1000])
    q1, q3 = np.quantile(values, [0.25, 0.75])
    inside = values[values <= q3 + 1.5 * (q3 - q1)]
    assert row.whisker_high == max(inside.max(), q3)


def test_community_media_rate(spark):
    data = [("r/big", i < 5) for i in range(10)] + [("r/nine", True)] * 9 + [("u_x", True)] * 20
    df = spark.createDataFrame(data, "subreddit string, has_media boolean")
    assert [tuple(r) for r in C.community_media_rate(df).collect()] == [("r/big", 10, 5, 50.0)]


USERS = "id string, has_label boolean"
ITEM = "id string, author string, type string, timestamp timestamp, word_count int"


@pytest.fixture
def diary(spark):
    def at(year, day):
        return dt.datetime(year, 1, day, 12)

    data = [
        ("1", "a", "post", at(2020, 1), 4), ("2", "a", "post", at(2020, 1), 8), ("3", "a", "comment", at(2020, 5), 1),
        ("4", "a", "post", at(2020, 10), 2), ("5", "b", "post", at(2022, 3), 3), ("6", "b", "comment", None, 9),
    ]
    users = spark.createDataFrame([("a", True), ("b", False), ("c", True)], USERS)
    return spark.createDataFrame(data, ITEM), users


def test_timelines(diary, rows):
    content, users = diary
    assert rows(T.yearly_content(content)) == [(2020, 3, 1), (2022, 1, 0)]
    assert rows(T.yearly_content(content, fill_gaps=True)) == [(2020, 3, 1), (2021, 0, 0), (2022, 1, 0)]
    assert rows(T.yearly_median_content(content, users)) == [
        (2020, False, 0.0), (2020, True, 4.0), (2022, False, 1.0), (2022, True, 0.0)
    ]
    assert rows(T.yearly_median_length(content, users, "post")) == [
        (2020, False, 0.0), (2020, True, 4.0), (2022, False, 3.0), (2022, True, 0.0)
    ]
    ratio = {r.author: r.activity_ratio for r in T.activity_ratio(content, users).collect()}
    assert ratio == {"a": 0.3, "b": 1.0}
    daily = {r.author: r.median_daily for r in T.median_daily_content(content, users).collect()}
    assert daily == {"a": 1.0, "b": 1.0}


def test_word_counts(spark, rows):
    df = spark.createDataFrame([("1", "the cat Cat"), ("2", "cat dog"), ("3", None)], "id string, text string")
    assert rows(W.term_counts(df, (), ["the"])) == [("cat", 3, 2), ("dog", 1, 1)]
    assert rows(W.word_frequencies(df, ["the"], min_df=2)) == [("cat", 3, 2)]
    plan = W.term_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_theme_means(spark):
    docs = spark.createDataFrame(
        [("1", True, "joy joy rain sun"), ("2", True, "nothing here"), ("3", False, "rain"), ("4", True, "?")],
        "id string, has_label boolean, text string",
    )
    lexicon = spark.createDataFrame([("mood", "joy"), ("weather", "rain"), ("weather", "sun")], "category string, term string")
    got = {(r.has_label, r.category): r.mean_freq for r in W.theme_means(docs, lexicon).collect()}
    assert got == {(True, "mood"): pytest.approx(0.5 / 3), (True, "weather"): pytest.approx(0.5 / 3), (False, "weather"): 1.0}


def test_scores(spark):
    docs = spark.createDataFrame([(i, "good bad bad x") for i in range(5)] + [(9, None)], "id int, text string")
    scores = W.score_texts(docs, W.lexicon_scorer({"good": ["good"], "bad": ["bad"]}), ["good", "bad"])
    assert scores.count() == 10
    assert {(r.label, r.score) for r in scores.collect()} == {("good", 0.25), ("bad", 0.5)}
    classes = docs.select(F.col("id").cast("string").alias("content_id"), (F.col("id") > 1).alias("has_label"))
    got = W.median_score_by_class(scores, classes, ["bad"]).collect()
    assert {(r.has_label, r.label, r.median_score) for r in got} == {(True, "good", 0.25), (False, "good", 0.25)}


def test_median_by_group(spark):
    df = spark.createDataFrame([(True, 1), (True, 4), (False, 9)], "has_label boolean, n int")
    got = {r.grp: r["median"] for r in C.median_by_group(df, "n").collect()}
    assert got == {"all": statistics.median([1, 4, 9]), "label": 2.5, "control": 9.0}
