import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from odd_tables import SMALL, no_docs, odd_docs  # noqa: F401
from authorloom.llm import quality, toxicity

LARGE = "/root/testdata/sf0.1"


def accuracy(found, labels, label):
    """(share of ones found, share of zeros kept) over held-out documents."""
    rows = found.where("held_out").join(labels, "doc_id").select(label, "predicted").collect()
    one = [r.predicted for r in rows if r[label] == 1]
    zero = [1 - r.predicted for r in rows if r[label] == 0]
    return np.mean(one), np.mean(zero)


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_toxicity(tables):
    hit, clean = accuracy(toxicity.toxicity(*tables), tables[1], "toxic")
    assert hit > 0.8 and clean > 0.99


def test_held_out_toxicity_of_few_labels(spark):
    """About 300 labelled rows, a seventh of them toxic: found by their words, not learned by heart."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    hit, clean = accuracy(toxicity.toxicity(docs, labels), labels, "toxic")
    assert hit > 0.5 and clean > 0.97


def test_pair_sum_is_the_double_loop():
    rng = np.random.default_rng(6)
    table = rng.normal(size=(toxicity.BUCKETS, 1 + toxicity.FACTORS)).astype(np.float32)
    machine = toxicity.Machine(0.3, table)
    texts = ["one two three", "", None, "Insult group! insult", " ".join(f"word{i}" for i in range(60))]
    terms, offsets = toxicity.hashed_terms(pa.array(texts))
    got = machine.margin(terms, offsets)
    for i in range(len(texts)):
        own = terms[offsets[i] : offsets[i + 1]].tolist()
        assert len(set(own)) == len(own)
        pairs = sum(float(table[a, 1:] @ table[b, 1:]) for k, a in enumerate(own) for b in own[:k])
        expected = 0.3 + sum(float(table[a, 0]) for a in own) + pairs / max(len(own) / toxicity.SCALE, 1)
        assert got[i] == pytest.approx(expected, rel=1e-3, abs=1e-3)


def test_forest_walk_is_the_walk_of_single_rows():
    rng = np.random.default_rng(8)
    rows = rng.random((200, 5))
    forest = quality.fit(rows, (rows[:, 0] + rows[:, 2] ** 2 > 0.9).astype(float), trees=12)

    def walk(row):
        total = forest.base
        for tree in range(len(forest.feature)):
            node = 0
            while node < forest.feature.shape[1]:
                right = row[forest.feature[tree, node]] > forest.cut[tree, node]
                node = 2 * node + (2 if right else 1)
            total += forest.value[tree, node - forest.feature.shape[1]]
        return total

    assert forest.margin(rows) == pytest.approx([walk(r) for r in rows])
    assert quality.fit(rows[:5], np.ones(5)).margin(rows[:2]).shape == (2,)


def test_held_out_quality(tables):
    good, bad = accuracy(quality.quality(*tables), tables[1], "quality")
    assert good > 0.98 and bad > 0.95


def test_driver_counts_the_sample_in_pieces(monkeypatch):
    """Beside the sample itself the driver holds half of it at most, and pieces change no weight."""
    rng = np.random.default_rng(3)
    terms = rng.integers(0, 3000, 2_000_000).astype(np.int32)
    offsets = np.concatenate(([0, 0], np.sort(rng.integers(0, len(terms), 500)), [len(terms)] * 2))
    labels = (rng.random(len(offsets) - 1) < 0.3).astype(float)
    whole = toxicity.fit(terms, offsets, labels, epochs=0)
    monkeypatch.setattr(toxicity, "PIECE", 1 << 12, raising=False)
    tracemalloc.start()
    machine = toxicity.fit(terms, offsets, labels, epochs=0)
    peak = tracemalloc.get_traced_memory()[1] - machine.table.nbytes
    tracemalloc.stop()
    assert peak < 8 * len(terms)
    assert machine.bias == whole.bias and np.array_equal(machine.table, whole.table)
    rare = toxicity.fit(np.array([5, 5, 9, 5, 5, 5]), np.array([0, 1, 1, 3, 4, 6]), np.array([1.0, 0, 1, 0, 1]), epochs=0)
    assert rare.table[5].any() and not rare.table[9].any()


def test_pairs_of_terms_are_learned():
    """Neither word alone is toxic, both together are: a sum of weights could not tell."""
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(1200):
        words = [f"w{rng.randint(0, 50)}" for _ in range(8)]
        a, b = i % 2 == 0, (i // 2) % 2 == 0
        words += ["insult"] * a + ["group"] * b
        texts.append(" ".join(words))
        labels.append(float(a and b))
    terms, offsets = toxicity.hashed_terms(pa.array(texts))
    machine = toxicity.fit(terms, offsets, np.array(labels), epochs=60)
    got = machine.margin(*toxicity.hashed_terms(pa.array(["insult w1", "group w2", "insult group w3", ""]))) > 0
    assert got.tolist() == [False, False, True, False]


def test_pairs_of_terms_that_are_balanced_alone_are_learned():
    """Each word is as frequent in both classes; only the pair tells them apart."""
    rng = random.Random(4)

    def text(a, b):
        return " ".join([f"w{rng.randint(0, 50)}" for _ in range(8)] + ["insult"] * a + ["group"] * b)

    kinds = [(a, b) for a in (0, 1) for b in (0, 1)]
    terms, offsets = toxicity.hashed_terms(pa.array([text(*kinds[i % 4]) for i in range(1200)]))
    labels = np.array([float(kinds[i % 4][0] == kinds[i % 4][1]) for i in range(1200)])
    machine = toxicity.fit(terms, offsets, labels, epochs=60)
    for a, b in kinds:
        got = machine.margin(*toxicity.hashed_terms(pa.array([text(a, b) for _ in range(50)]))) > 0
        assert (got == (a == b)).mean() > 0.9


def test_trees_learn_a_corner():
    rng = np.random.default_rng(0)
    rows = rng.random((3000, 4))
    labels = ((rows[:, 1] > 0.6) & (rows[:, 3] < 0.5)).astype(float)
    forest = quality.fit(rows[:2000], labels[:2000], trees=30)
    assert ((forest.margin(rows[2000:]) > 0) == (labels[2000:] > 0.5)).mean() > 0.97


@pytest.mark.parametrize("module, name", [(toxicity, "toxicity"), (quality, "quality")])
def test_odd_rows(spark, odd_docs, no_docs, module, name):
    run = getattr(module, name)
    kind = "doc_id long, quality int, toxic int, text string"
    rows = [(1, 0, 1, "x"), (3, 1, 0, None), (3, 1, 0, None), (4, None, None, ""), (None, 1, 1, ""), (2, 0, 1, "")]
    labels = spark.createDataFrame(rows, kind)
    for given in (labels, labels.where("false"), labels.where("doc_id = 3")):
        got = run(odd_docs, given).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert run(no_docs, labels).count() == 0


def test_only_bad_documents_go(spark, tables):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    machine = toxicity.train(*tables)
    kept = toxicity.keep_clean(docs, machine)
    assert kept.columns == docs.columns
    scores = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, s in scores.items() if s < 0.5}
