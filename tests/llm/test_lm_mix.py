import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from odd_tables import SMALL, no_docs, odd_docs  # noqa: F401
from authorloom.llm import frequent, lm_mix, shared

LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    spaces = " \t\n\x0b\x0c\r"
    lowered = (text or "").translate(LOWER)
    for c in spaces:
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w] + [None]


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def learner(texts):
    out = lm_mix.Learner()
    for key, _ in lm_mix.windows(*shared.utf8(pa.array(texts))):
        out.learn(key)
    return out


def fitted(texts):
    known = learner(texts)
    odds = np.log((known.counts[:, 1] + lm_mix.DELTA) / (known.counts[:, 0] + lm_mix.DELTA))
    refined = np.random.default_rng(1).uniform(0.01, 0.99, 256 * lm_mix.BUCKETS)
    return lm_mix.Model(odds.astype(np.float32), known.weights, refined)


def check_base(rows, docs):
    counts = Counter(t for d in docs if not is_held_out(d.doc_id) for t in tokens(d.text))
    n, v = sum(counts.values()), len(counts)
    expected = []
    for d in docs:
        own = tokens(d.text)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        expected.append((d.doc_id, is_held_out(d.doc_id), len(own), sum(counts[t] > 0 for t in own), n, round(base, 6)))
    got = [(*r[:5], round(r.base_score, 6)) for r in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("keys", [1 << 16, 40, 1])
def test_base_score_counts_all_tokens(spark, monkeypatch, keys):
    monkeypatch.setattr(frequent.least_count, "__defaults__", (keys,))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = lm_mix.language_model(docs).collect()
    check_base(rows, docs.collect())
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_odd_rows(odd_docs, no_docs, spark):
    rows = lm_mix.language_model(odd_docs).collect()
    check_base(rows, odd_docs.collect())
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    assert lm_mix.language_model(no_docs).count() == 0
    nobody = spark.createDataFrame([(i, "a b") for i in range(200) if is_held_out(i)], "doc_id long, text string")
    alone = lm_mix.language_model(nobody).collect()
    assert alone and all((r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) for r in alone)
    assert alone[0].score == pytest.approx(8 * 4 * math.log10(0.5), rel=1e-3)


def test_chances_of_all_next_bytes_add_up_to_one():
    model = fitted(["the cat sat on the mat", "a cat and a hat", "été 漢字"])
    for past in (b"\0\0\0\0\0", b"e cat", "é 漢"[:2].encode()[-5:].rjust(5, b"\0"), b"zzzzz"):
        context = int.from_bytes(past, "big")
        windows = np.array([context << 8 | b for b in range(256)], np.uint64)
        assert (10 ** model.chance(windows)).sum() == pytest.approx(1, abs=0.01)


def test_score_is_the_sum_over_single_positions(monkeypatch):
    """Cut to parts of any size, and with equal windows treated once, against one position at a time."""
    model = fitted(["the cat sat on the mat"] * 3)
    texts = ["the cat sat", "", "on on on on", "漢字 the cat", "x" * 50]
    expected = []
    for text in texts:
        data = bytes(lm_mix.REACH) + text.encode() + bytes([lm_mix.END])
        keys = [int.from_bytes(data[i - 5 : i + 1], "big") for i in range(5, len(data))]
        expected.append(sum(float(model.chance(np.array([k], np.uint64))[0]) for k in keys))
    data, offsets = shared.utf8(pa.array(texts))
    assert model.texts(data, offsets) == pytest.approx(expected, abs=1e-4)
    whole = lm_mix.windows
    monkeypatch.setattr(lm_mix, "windows", lambda d, o: whole(d, o, limit=7))
    assert model.texts(data, offsets) == pytest.approx(expected, abs=1e-4)


def test_slots_count_every_bit():
    known = learner(["ab", "ab", "b"])
    for order, (bits, first) in enumerate(zip(lm_mix.SLOT_BITS, lm_mix._FIRST, strict=False)):
        part = known.counts[first : first + (1 << bits)]
        assert part.sum() == 8 * (3 + 3 + 2), order
    assert known.bits == 64


def test_parts_add_up(spark):
    """Counts of all tasks are added; held-out text of the same kind is foretold better than noise."""
    text = "the quick brown fox jumps over the lazy dog and runs home again "
    rows = [(i, text[i % 20 :] * 3) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    parts = lm_mix.gathered(docs).cache()
    whole = learner([t for _, t in rows])
    model = lm_mix.model(parts)
    expected = np.log((whole.counts[:, 1] + lm_mix.DELTA) / (whole.counts[:, 0] + lm_mix.DELTA))
    assert np.abs(model.odds - expected).max() < 0.01
    data, offsets = shared.utf8(pa.array([text, text[::-1]]))
    good, bad = lm_mix.Model(model.odds.astype(np.float32), model.weights, model.refined).texts(data, offsets)
    assert good > bad / 4 and good / len(text) > -0.3
