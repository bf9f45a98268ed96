"""Steps that must not move or read texts more often than they need to, with the rows they must still give."""

from __future__ import annotations

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from authorloom.plans.catalogue.registry import QUERIES, Inputs

NOW = datetime(2020, 5, 1)
TEXTS = ["the migraine of an abbot", "b without its first letter", "cab {\"label\": \"yes\"}", "", None, "zz aa", "Yes ab no " * 9]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with null and repeated keys."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, TEXTS[i % 7], ("en", "de", None)[i % 3], "web", 1) for i in range(60)] + [(7, "again ab", "en", "web", 1), (None, "x", "en", "web", 1)]
    events = [(i, NOW, i % 9, ("purchase", "view")[i % 2], 1.0, "") for i in range(55)] + [(7, NOW, 3, "view", 1.0, ""), (None, NOW, 3, "view", 1.0, "")]
    labels = [(i, i % 2, int(i % 4 == 0)) for i in range(0, 60, 2)] + [(8, 0, 1), (None, 1, 1)]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("events", events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("region", [(i, f"r{i}") for i in range(5)], "r_regionkey int, r_name string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture
def plain_plans(spark):
    """Joins that shuffle, planned once."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "false")
    spark.conf.set(names[1], "-1")
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def same(one, two) -> bool:
    order = sorted(one.columns)
    first, second = (Counter(map(repr, x.select(*order).collect())) for x in (one, two))
    return first == second and sum(first.values()) > 0


def test_evidence_is_found_without_moving_texts_and_once(spark, folder, plain_plans, monkeypatch):
    inputs = Inputs(spark, folder)
    flagged = inputs.flagged
    assert same(flagged, inputs.view("v_content_flagged").drop("text"))
    # no exchange stands between the text and its flag
    lines = plan(flagged).splitlines()
    assert not any("Exchange" in line and "text" in line for line in lines)
    assert max(i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x and i < next(
        j for j, y in enumerate(lines) if "igraine" in y)) >= 0
    from authorloom.plans.catalogue import stored

    written = []
    monkeypatch.setattr(stored, "upsert_labels", lambda _, __, rows, ___: written.append(plan(rows)))
    monkeypatch.setattr(stored, "evidence_table", lambda *_: type("T", (), {"compact": lambda *a, **k: 0})())
    monkeypatch.setattr(stored, "stored_users", lambda *_: None)
    QUERIES["levelled_users"](spark, folder)
    assert len(written) == stored.BATCHES and not any("documents" in p for p in written)


def test_answers_are_written_where_texts_are_read(spark, folder, plain_plans):
    inputs = Inputs(spark, folder)
    assert same(inputs.answers, inputs.view("v_answers"))
    text = plan(inputs.answers)
    assert "LIKE %a%b%" not in text and text.count("perhaps") == 1


def test_tokens_are_counted_where_the_join_left_their_text(spark, folder, plain_plans):
    inputs = Inputs(spark, folder)
    assert same(inputs.content, inputs.view("v_content"))
    assert "hashpartitioning(id#" not in "".join(x for x in plan(QUERIES["tokenize"](spark, folder)).splitlines() if "term" in x)


def test_trigrams_are_no_rows_of_the_plan(spark):
    from authorloom.operators.langid import detect_language, language_profiles

    long = "\U00020000\U00020001\U00020002 ab"  # letters beyond 16 bits are letters like others
    rows = [("1", "Das ist gut, das ist", "de"), ("2", "that IS good 7 that", "en"), ("3", long, None), ("4", None, "en"), ("5", "!", "en")]
    texts = spark.createDataFrame(rows, "id string, text string, lang string")
    profiles = language_profiles(texts)
    counts = Counter()
    for _, text, lang in rows:
        flat = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        padded = f" {' '.join(flat)} "
        counts.update((lang, padded[i : i + 3]) for i in range(len(padded) - 2))
    assert {(r.lang, r.gram) for r in profiles.collect()} == set(counts)
    asked = texts.unionByName(spark.createDataFrame([("1", "das", "de"), (None, "good", "en")], texts.schema))
    found = detect_language(asked, profiles)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("1", "de"), ("2", "en"), ("3", None), (None, "en")], key=repr)
    assert "explode(" not in plan(found) and "explode(" not in plan(profiles)
    assert detect_language(asked, profiles.limit(0)).collect() == []


def test_rewritten_texts_are_counted_by_their_blanks(spark):
    from authorloom.functions.text import clean_text, flat_word_count, word_count

    odd = [(x,) for x in ("", " ", "a", "a b\x85c ", "(25 F) x [a](b)", "éé \U0001f600 y", None)]
    text = clean_text(F.col("t"))
    rows = spark.createDataFrame(odd, "t string").select(word_count(text).alias("a"), flat_word_count(text).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_terms_are_sorted_without_a_lambda(spark):
    from authorloom.operators.words import exploded_terms

    texts = spark.createDataFrame([(["b", "a", "b"],)], "t array<string>")
    terms = exploded_terms(texts, F.col("t"))
    assert sorted(map(tuple, terms.collect())) == [("a", 1, 1), ("b", 1, 0), ("b", 1, 1)]
    assert "sort_array" in plan(terms)


def test_phrases_look_at_the_first_letter(spark):
    from authorloom.functions.phrases import compile_phrases

    pattern = compile_phrases(["my kiss", "so ill", "? has flu"], "flu", ["flu", "Influenza"])
    assert pattern.guard.startswith("(?=[")
    texts = ["MY KISS", "xx so İll", "my kiſs", "he has ınfluenza", "HE HAS FLU", "none"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(
        pattern.search(F.col("t")).alias("a"), F.col("t").rlike(pattern.full).alias("b")).collect()
    assert [r.a for r in found] == [r.b for r in found] and sum(r.a for r in found) >= 4
    assert not compile_phrases(["été"], "x", []).guard.startswith("(?=")


def test_classifier_reads_texts_once(spark, monkeypatch):
    from authorloom.operators import linear

    rows = [(str(i), "a", i % 2 == 0, ("train", "train", "val")[i % 3], ("good day", "bad night")[i % 2] + f" w{i % 4}") for i in range(30)]
    df = spark.createDataFrame(rows, "id string, author string, has_label boolean, split string, text string")
    written = []
    monkeypatch.setattr(linear, "materialise", lambda d, name: written.append(plan(d)) or d.localCheckpoint())
    out = linear.text_classifier_lr(df, iterations=5)
    assert len(written) == 1 and "text" not in plan(out)
    assert [r.id for r in out.orderBy("id").collect()] == sorted(r[0] for r in rows if r[3] == "val")
    assert all(r.predicted == int(r.has_label) for r in out.collect())


def test_media_of_items_in_one_pass(spark, plain_plans):
    from authorloom.operators import ingest as I

    items = [("1", ["u1", "u2"], "a"), ("1", ["u9"], "b"), ("2", ["u1"], "c"), ("3", [], "d"), ("4", ["u4"], "e"), ("1", [], "f"), ("5", None, "g")]
    status = [("1", "u2", True), ("1", "u2", True), ("2", "u1", False), ("4", "u5", True), ("5", "u1", True), ("4", None, True), (None, "u4", True)]
    items = spark.createDataFrame(items, "id string, media_urls array<string>, text string")
    status = spark.createDataFrame(status, "content_id string, url string, ok boolean")
    got = I.with_obtained_media(items, status)
    assert same(got, I.with_has_media(items, I.fetched_media(I.media_manifest(items), status)))
    lines = plan(got).splitlines()
    assert sum("Exchange" in x for x in lines) == 2  # one of the items, one of the links


def test_metrics_read_the_scores_once(spark, folder):
    from authorloom.operators.evaluation import binary_metrics
    from authorloom.plans.catalogue.experiments import _RATES, _scores
    from authorloom.plans.catalogue.registry import rounded

    got = QUERIES["content_metrics"](spark, folder)
    assert "regexp_extract_all" not in plan(got)  # texts were split into words before, not for each of two readers
    scores = rounded(_scores(Inputs(spark, folder)), "proba")
    assert same(got, rounded(binary_metrics(scores, ["split"], "has_label", "predicted", "proba"), *_RATES, "roc_auc"))


def test_patterns_run_where_their_marks_are(spark):
    from authorloom.functions import patterns as P
    from authorloom.functions import text as X

    steps = {
        X.remove_links: P.LINK_GREEDY, X.remove_mentions: P.java(P.MENTION, True),
        X.remove_spoilers: P.SPOILER, X.remove_age_gender: P.java(P.AGE_GENDER, True),
    }
    odd = ["", None, "plain", "R/x u/ /r", "[a](b) [c]", "a](b)", ">!!<", "!>!<", "> !", "(25 F) (x)", "25 F)", "K/r ʁ/x"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    for step, pattern in steps.items():
        both = rows.select(step(F.col("t")).alias("a"), F.regexp_replace("t", pattern, "").alias("b")).collect()
        assert [r.a for r in both] == [r.b for r in both]
        assert "Contains(" in plan(rows.select(step(F.col("t")).alias("a")))
    assert plan(rows.select(X.clean_text(F.col("t")).alias("a"))).count("non-?binary") == 2  # written out once


def moved(df) -> set[str]:
    """Names of the columns that the plan sends through an exchange."""
    found, nodes = set(), [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if "Exchange" in node.nodeName():
            found |= {node.output().apply(i).name() for i in range(node.output().size())}
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_users_of_a_batch_are_told_without_moving_texts(spark, folder, plain_plans):
    from authorloom.plans.catalogue.ingest import _chain, _read_items, _twice

    inputs = Inputs(spark, folder)
    got = QUERIES["ingest_chain_users"](spark, folder)
    assert "author" in moved(got) and not moved(got) & {"text", "body", "title", "selftext"}
    (users, content), (again, rows) = _chain(inputs, read=True), _chain(inputs)
    assert same(users, again) and same(got, again.select("id", "has_label"))
    # copies of an id with other authors, kinds and texts end as the same row either way
    assert same(content, rows.withColumn("text_hash", F.xxhash64("text")).drop("text"))
    read = _read_items(inputs, _twice(inputs.raw_texts))
    assert read.columns.count("text_hash") == 1 and read.count() == _twice(inputs.raw.where("body IS NOT NULL")).count()


def test_languages_are_found_without_moving_texts(spark, folder, plain_plans):
    from authorloom.operators.langid import detect_language, filter_detected, language_profiles

    c = Inputs(spark, folder)
    profiles = language_profiles(c.content)
    for name, by_content in (
        ("lang_detect", detect_language(c.content, profiles)),
        ("lang_filter_detected", filter_detected(c.content, profiles).select("id", "has_media")),
    ):
        got = QUERIES[name](spark, folder)
        assert same(got, by_content)
        assert "id" in moved(got) and "text" not in moved(got)


def test_words_of_letters_are_those_of_the_pattern(spark):
    from authorloom.operators.langid import _letters, text_grams

    # each code point of the first planes in a text of its own kind, and texts at the edges
    odd = ["", " ", "a", "ab", " a  b ", "7", "İI ΑΣ Σ", "ée", "\U0001d400\U00020000x", "a\x00b", "x" * 9, "1"]
    odd += ["".join(map(chr, range(i, i + 64))) for i in range(0, 0x30000, 64) if not 0xD800 <= i < 0xE000]
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("t"), r"[^\p{L}]+", " ")), F.lit(" "))
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select(F.lower("t").alias("low"), flat.alias("flat")).collect()
    grams, sizes = text_grams([r.low for r in rows], _letters(spark))
    assert sizes.tolist() == [len(r.flat) - 2 for r in rows]
    expected = [r.flat[i : i + 3] for r in rows for i in range(len(r.flat) - 2)]
    mask = (1 << 21) - 1
    assert ["".join(chr(g >> s & mask) for s in (42, 21, 0)) for g in grams.tolist()] == expected
