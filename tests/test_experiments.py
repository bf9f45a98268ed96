import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from authorloom.functions.text import tokenize
from authorloom.operators import evaluation as E
from authorloom.operators.prefix import cut_ranges
from authorloom.operators.answers import author_weighted_share, parse_json_answer, parse_label
from authorloom.operators.bag_of_words import EACH_TEXT, fit_naive_bayes, fit_vocab, predict_naive_bayes, train_terms
from authorloom.operators.prompts import (
    PromptTemplate,
    attach_images,
    build_prompts,
    chat_messages,
    few_shot_examples,
)
from authorloom.operators.split import TrainConfig, experiment_base, stratified_author_split, train_filter
from authorloom.plans.catalogue.registry import Inputs
from authorloom.plans.experiments import evaluate_answers, prompt_table, run_grid, split_rows
from authorloom.schemas import RESULT

# Twelve published test matrices (tn, fp, fn, tp) with accuracy, F1, precision and recall.
PUBLISHED = [
    ((287, 509, 45, 185), (0.4600389863547758, 0.4004329004329004, 0.2665706051873199, 0.8043478260869565)),
    ((337, 459, 63, 167), (0.49122807017543857, 0.3901869158878505, 0.26677316293929715, 0.7260869565217392)),
    ((150, 646, 17, 213), (0.3538011695906433, 0.39118457300275483, 0.2479627473806752, 0.9260869565217391)),
    ((259, 537, 52, 178), (0.42592592592592593, 0.37671957671957673, 0.24895104895104894, 0.7739130434782608)),
    ((492, 304, 80, 150), (0.6257309941520468, 0.43859649122807015, 0.3303964757709251, 0.6521739130434783)),
    ((414, 382, 58, 172), (0.571150097465887, 0.4387755102040816, 0.3104693140794224, 0.7478260869565218)),
    ((314, 482, 46, 184), (0.4853801169590643, 0.4107142857142857, 0.27627627627627627, 0.8)),
    ((371, 425, 59, 171), (0.5282651072124757, 0.41404358353510895, 0.28691275167785235, 0.7434782608695653)),
    ((675, 121, 181, 49), (0.7056530214424951, 0.245, 0.28823529411764703, 0.21304347826086956)),
    ((674, 122, 180, 50), (0.7056530214424951, 0.24875621890547264, 0.29069767441860467, 0.21739130434782608)),
    ((333, 463, 11, 219), (0.5380116959064327, 0.48026315789473684, 0.32111436950146627, 0.9521739130434783)),
    ((331, 465, 11, 219), (0.5360623781676414, 0.47921225382932164, 0.3201754385964912, 0.9521739130434783)),
]


def test_published_metrics(spark):
    counts = spark.createDataFrame([(i, *m) for i, (m, _) in enumerate(PUBLISHED)], "i int, tn int, fp int, fn int, tp int")
    got = E.with_metrics(counts).withColumn("text", E.confusion_text()).orderBy("i").collect()
    for row, (matrix, metrics) in zip(got, PUBLISHED):
        assert (row.accuracy, row.f1, row.precision, row.recall) == pytest.approx(metrics, rel=1e-12)
        tn, fp, fn, tp = matrix
        assert row.text == f"[[{tn}, {fp}], [{fn}, {tp}]]"


def test_threshold_grid_is_numpy_arange():
    assert list(E.THRESHOLDS) == list(np.arange(0.1, 0.91, 0.05))


def auc_by_pairs(truth, score):
    pos = [s for t, s in zip(truth, score) if t]
    neg = [s for t, s in zip(truth, score) if not t]
    if not pos or not neg:
        return 0.5
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc(spark):
    rng = np.random.default_rng(3)
    cases = {
        "known": ([True, False, False, True, False], [0.9, 0.7, 0.5, 0.5, 0.1]),
        "one class": ([True, True], [0.2, 0.4]),
        "random": (list(rng.random(300) < 0.3), list(np.round(rng.random(300), 2))),
        "close": (list(rng.random(200) < 0.5), list(0.5 + rng.random(200) * 1e-9)),
        "ends": (list(rng.random(60) < 0.5), list(rng.integers(0, 2, 60).astype(float))),
    }
    data = [(k, bool(t), float(s)) for k, (ts, ss) in cases.items() for t, s in zip(ts, ss)]
    got = {r.k: r.roc_auc for r in E.roc_auc(spark.createDataFrame(data, "k string, y boolean, s double"), ["k"], "y", "s").collect()}
    assert got["known"] == 0.75 and got["one class"] == 0.5
    for name, (truth, score) in cases.items():
        assert got[name] == pytest.approx(auc_by_pairs(truth, score), rel=1e-12), name


def authors_frame(spark, data, dataset="validation", name="x"):
    rows = [(name, dataset, f"a{i}", bool(t), float(p)) for i, (t, p) in enumerate(data)]
    return spark.createDataFrame(
        rows, "experiment_name string, dataset string, author string, true_label boolean, predicted_probability double"
    )


def f1_at(data, threshold):
    tp = sum(t and p >= threshold for t, p in data)
    wrong = sum(t != (p >= threshold) for t, p in data)
    return 2 * tp / (2 * tp + wrong) if tp or wrong else 0.0


def test_sweep_and_best_threshold(spark):
    rng = np.random.default_rng(5)
    data = [(bool(rng.random() < 0.4), float(np.round(rng.random(), 2))) for _ in range(80)]
    sweep = E.threshold_sweep(authors_frame(spark, data))
    got = {r.threshold: r for r in sweep.collect()}
    assert sorted(got) == list(E.THRESHOLDS)
    for t, row in got.items():
        assert row.f1 == pytest.approx(f1_at(data, t)) and row.tn + row.fp + row.fn + row.tp == 80
    expected = max(E.THRESHOLDS, key=lambda t: (f1_at(data, t), -t))
    assert E.best_threshold(sweep).first().best_threshold == expected


def test_ties_take_the_lowest_threshold(spark):
    best = E.best_threshold(E.threshold_sweep(authors_frame(spark, [(True, 0.5), (False, 0.0)]))).first()
    assert best.best_threshold == 0.1 and best.val_f1 == 1.0


@pytest.mark.parametrize("data", [[(True, 0.01), (False, 0.9)], [(True, 0.9), (True, 0.8)], [(False, 0.9)]])
def test_no_usable_threshold(spark, data):
    best = E.best_threshold(E.threshold_sweep(authors_frame(spark, data))).first()
    assert best.best_threshold == 0.5 and best.val_f1 is None and best.val_accuracy is None


def test_result_row(spark):
    val = authors_frame(spark, [(True, 0.9), (False, 0.2), (False, 0.7)])
    test = authors_frame(spark, [(True, 0.9), (False, 0.2), (True, 0.3), (False, 0.95)], "test")
    result = E.experiment_result(val.unionByName(test), "family", 2)
    assert result.columns == RESULT.names
    row = result.first()
    assert row.best_threshold == 0.7000000000000002 and row.val_f1 == 1.0 and row.val_roc_auc == 1.0
    assert row.test_confusion_matrix == "[[1, 1], [1, 1]]"
    assert (row.num_users_val, row.num_users_test, row.test_accuracy) == (3, 4, 0.5)


def test_softmax(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 3.0],), ([900.0, -900.0],)], "logits array<double>")
    got = [tuple(r) for r in E.logits_to_proba(df).select("proba", "predicted").collect()]
    assert got[0] == (0.5, 0) and got[1] == (pytest.approx(1 / (1 + math.exp(-2))), 1)
    assert got[2] == (pytest.approx(0.0, abs=1e-300), 0)


def test_split_is_stratified_and_repeatable(spark):
    authors = spark.range(1000).select(F.concat(F.lit("u"), "id").alias("author"), (F.col("id") % 4 == 0).alias("has_label"))
    split = stratified_author_split(authors)
    counts = {(r.has_label, r.split): r["count"] for r in split.groupBy("has_label", "split").count().collect()}
    assert counts == {
        (True, "train"): 175, (True, "val"): 37, (True, "test"): 38,
        (False, "train"): 525, (False, "val"): 112, (False, "test"): 113,
    }
    again = stratified_author_split(authors.orderBy(F.desc("author")).repartition(3))
    assert sorted(split.collect()) == sorted(again.collect())
    rough = stratified_author_split(authors, exact=False).groupBy("split").count().collect()
    assert {r.split for r in rough} == {"train", "val", "test"} and sum(r["count"] for r in rough) == 1000
    assert 640 < {r.split: r["count"] for r in rough}["train"] < 760


def test_base_drops_disclosures_and_blanks(spark, rows):
    users = spark.createDataFrame([("a", True, "s")], "id string, has_label boolean, first_found_in string")
    content = spark.createDataFrame(
        [("1", "a", "x", False), ("2", "a", "x", True), ("3", "a", " \t ", False), ("4", "a", None, False),
         ("5", "zz", "x", False), ("6", "a", "y", None)],
        "id string, author string, text string, has_pattern boolean",
    )
    assert rows(experiment_base(users, content), "id", "has_label") == [("1", True), ("6", True)]


def test_train_filter_leaves_other_splits(spark, rows):
    df = spark.createDataFrame(
        [("1", "train", "r/a", 5, 9), ("2", "train", "r/b", 50, 9), ("3", "test", "r/a", 1, 1), ("4", "train", None, 50, 9)],
        "id string, split string, first_found_in string, word_count int, n_content int",
    )
    config = TrainConfig("c", ("r/a",), min_words=10, min_content=5)
    assert rows(train_filter(df, config), "id") == [("2",), ("3",), ("4",)]


def brute_force_bayes(train, docs, max_features, min_df, max_df):
    """Multinomial naive Bayes with plain dictionaries."""
    tf, df = defaultdict(lambda: [0, 0]), Counter()
    for label, words in train:
        for word in words:
            tf[word][label] += 1
        df.update(set(words))
    fits = [w for w in tf if min_df <= df[w] <= max_df * len(train)]
    vocab = sorted(fits, key=lambda w: (-sum(tf[w]), w))[:max_features]
    sums = [sum(tf[w][y] for w in vocab) for y in (0, 1)]
    share = sum(label for label, _ in train) / len(train)
    out = []
    for words in docs:
        odds = math.log(share) - math.log(1 - share)
        for word in words:
            if word in vocab:
                odds += math.log((tf[word][1] + 1) / (sums[1] + len(vocab)))
                odds -= math.log((tf[word][0] + 1) / (sums[0] + len(vocab)))
        out.append(1 / (1 + math.exp(-odds)))
    return set(vocab), out


def test_naive_bayes_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i:02d}" for i in range(40)]
    texts = [" ".join(rng.choice(words[: 20 + 20 * (i % 2)], 12)) for i in range(60)] + ["unseen words only", ""]
    data = [(str(i), f"a{i}", i % 2 == 1, "train" if i < 40 else "test", t, 12) for i, t in enumerate(texts)]
    df = spark.createDataFrame(
        data, "id string, author string, has_label boolean, split string, text string, word_count int"
    ).withColumn("first_found_in", F.when(F.col("id") % 5 == 0, "r/off").otherwise("r/on")).withColumn("n_content", F.lit(3))
    configs = [TrainConfig("all"), TrainConfig("off", ("r/off",))]
    terms = train_terms(df.where("split = 'train'"), configs)
    vocab = fit_vocab(terms, configs, max_features=15, min_df=2, max_df=0.6)
    model = fit_naive_bayes(vocab)
    got = predict_naive_bayes(df.where("split = 'test'"), model, configs).collect()
    for config in configs:
        train = [(int(r[2]), r[4].split()) for r in data if r[3] == "train" and (config.name == "all" or int(r[0]) % 5)]
        known, expected = brute_force_bayes(train, [r[4].split() for r in data if r[3] == "test"], 15, 2, 0.6)
        mine = {r.term for r in vocab.where(F.col("experiment_name") == config.name).collect()}
        assert mine == known
        proba = {r.id: r.proba for r in got if r.experiment_name == config.name}
        assert [proba[r[0]] for r in data if r[3] == "test"] == pytest.approx(expected, rel=1e-9)
    assert model.where(F.col("term") == EACH_TEXT).count() == 2


def test_author_mean(spark):
    df = spark.createDataFrame(
        [("x", "test", "a", True, 0.2), ("x", "test", "a", True, 0.4), ("x", "test", "b", False, 1.0)],
        "experiment_name string, dataset string, author string, has_label boolean, proba double",
    )
    got = {r.author: (r.true_label, r.predicted_probability) for r in E.author_mean_proba(df, digits=9).collect()}
    assert got == {"a": (True, 0.3), "b": (False, 1.0)}


def parse(spark, fn, answers):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, answer string")
    return [(r.label, float(r.confidence)) for r in fn(df).orderBy("i").collect()]


def test_plain_answers(spark):
    answers = ["YES", " no\n", "assistant yes", "ASSISTANT\n NO", "yes.", "", None]
    assert parse(spark, parse_label, answers) == [(1, 1.0), (0, 1.0), (1, 1.0), (0, 1.0), (-1, 0.0), (-1, 0.0), (-1, 0.0)]


def test_json_answers(spark):
    cases = {
        'ok {"label": "YES", "confidence": 0.75} done': (1, 0.75),
        '{"label": " no ", "confidence": 0.25}': (0, 0.25),
        '{"label": "yes"}': (1, 0.5),
        '{"label": "yes", "confidence": 1.5}': (-1, 0.0),
        '{"label": "yes", "confidence": "0.5"}': (-1, 0.0),
        '{"label": "yes", "confidence": null}': (-1, 0.0),
        '{"label": "yes", "confidence": true}': (1, 1.0),
        '{"label": "yes", "confidence": 0}': (1, 0.0),
        '{"label": 1, "confidence": 1}': (-1, 0.0),
        '{"confidence": 1}': (-1, 0.0),
        '{"label": "yes", "confi': (-1, 0.0),
        '{"label": "yes"} and {"label": "no"}': (-1, 0.0),
        "none": (-1, 0.0),
        '{"label":\n"yes",\n"confidence": 1}': (1, 1.0),
    }
    assert parse(spark, parse_json_answer, list(cases)) == list(cases.values())


def test_weighted_share(spark):
    df = spark.createDataFrame(
        [("a", True, 1, 0.75), ("a", True, 0, 0.25), ("a", True, -1, 0.0), ("b", False, -1, 0.0), ("c", False, 0, 1.0)],
        "author string, true_label boolean, label int, confidence double",
    )
    got = {r.author: r.predicted_probability for r in author_weighted_share(df).collect()}
    assert got == {"a": 0.75, "b": 0.5, "c": 0.0}


def test_prompts_and_messages(spark):
    template = PromptTemplate(task="Q {positive}/{negative}?", answer="A.", answer_confidence="J.", role="R.")
    content = spark.createDataFrame([("1", "hi", True), ("2", "yo", False)], "id string, text string, has_media boolean")
    train = spark.createDataFrame(
        [(str(i), f"t{i}", i < 3) for i in range(6)], "id string, text string, has_label boolean"
    )
    examples = few_shot_examples(train)
    assert sorted(r.has_label for r in examples.collect()) == [False, False, True, True]
    prompt = build_prompts(content, "few_shot", template, examples).where("id = '1'").first().prompt
    lines = prompt.split("\n")
    assert lines[0] == "Q YES/NO?" and lines[-2:] == ["Text: hi", "A."]
    assert [x for x in lines if x.startswith("Label")] == ["Label: YES"] * 2 + ["Label: NO"] * 2
    assert build_prompts(content, "expert_confidence", template).first().prompt == "R.\nQ YES/NO?\nText: hi\nJ."
    with pytest.raises(ValueError):
        build_prompts(content, "guess", template)
    media = spark.createDataFrame(
        [("1", f"image{i}.png") for i in (3, 1, 4, 2)] + [("2", "image1.png")], "content_id string, image string"
    )
    rows = attach_images(build_prompts(content, "plain", template), media)
    assert {r.id: r.images for r in rows.collect()} == {"1": ["image1.png", "image2.png", "image3.png"], "2": []}
    message = chat_messages(rows).where("id = '1'").first().messages[0]
    assert [p.type for p in message.content] == ["image"] * 3 + ["text"]
    assert message.content[-1].text == "Q YES/NO?\nText: hi\nA."


@pytest.mark.parametrize("family", ["bag_of_words", "linear"])
def test_run_grid(spark, family):
    inputs = Inputs(spark, "/root/testdata/sf0.01")
    rows = split_rows(inputs.enriched, inputs.rewritten)
    configs = [TrainConfig("all"), TrainConfig("long", (), 29, 5)]
    options = {"features": 1 << 10, "iterations": 3} if family == "linear" else {}
    predictions, results = run_grid(rows, configs, family, 2, **options)
    table = {r.experiment_name: r for r in results.collect()}
    assert set(table) == {"all", "long"} and results.columns == RESULT.names
    for name, row in table.items():
        assert sum(int(x) for x in row.test_confusion_matrix.replace("[", "").replace("]", "").split(",")) == row.num_users_test
        part = predictions.where(F.col("experiment_name") == name)
        assert part.count() == row.num_users_test + row.num_users_val
    assert table["all"].test_roc_auc is not None


def test_auc_of_scores_that_pile_up(spark):
    """Nine tenths below 1e-12: equal to the count of pairs, and no range holds them all."""
    rng = np.random.default_rng(1)
    scores = np.concatenate([10.0 ** rng.uniform(-300, -12, 900), 1 - 10.0 ** rng.uniform(-15, -1, 90), [0, 0, 1, 1, 0.5, 0.5, 5e-324]])
    truth = rng.random(len(scores)) < 0.3 + 0.3 * (scores > 0.5)
    df = spark.createDataFrame([(1, bool(t), float(s)) for t, s in zip(truth, scores)], "k int, t boolean, s double")
    one, zero = scores[truth][:, None], scores[~truth][None, :]
    expected = ((one > zero).sum() + 0.5 * (one == zero).sum()) / (one.size * zero.size)
    assert E.roc_auc(df, ["k"], "t", "s").first().roc_auc == pytest.approx(expected, abs=1e-12)
    largest = cut_ranges(df, ["k"], "s", 32).groupBy("_range").count().agg(F.max("count")).first()[0]
    assert largest < 70


def test_filter_tells_what_it_needs(spark):
    inputs = Inputs(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError, match="n_content"):
        train_filter(split_rows(inputs.users, inputs.counted), TrainConfig("x", min_content=5))


def test_external_answers(spark):
    inputs = Inputs(spark, "/root/testdata/sf0.001")
    rows = split_rows(inputs.users, inputs.counted)
    messages = prompt_table(rows, "plain", inputs.media)
    assert messages.count() == rows.where("split <> 'train'").count()
    answers = messages.select(
        F.lit("zs").alias("experiment_name"), "split", F.col("id").alias("content_id"), "author",
        F.col("has_label").alias("true_label"), F.when(F.col("has_label"), "yes").otherwise("no").alias("answer"),
    )
    predictions, results = evaluate_answers(answers)
    row = results.first()
    assert row.num_users_test == predictions.where("dataset = 'test'").count() > 0


def test_tokens_of_model_and_text_agree(spark):
    df = spark.createDataFrame([("A cat, a_b ÜBER 12",)], "t string")
    assert df.select(tokenize(F.col("t"))).first()[0] == ["cat", "a_b", "über", "12"]
