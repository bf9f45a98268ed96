import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from odd_tables import SMALL, no_docs, odd_docs  # noqa: F401
from authorloom.llm import collocations as co

LOWER = {i: i + 32 for i in range(65, 91)}


def pieces(text):
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
        yield [w for w in re.split("[\x20\x09]+", piece) if w]


def grams(rows):
    """Counts of all phrases of up to three words of each language, and of its words."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return f, n


def brute(rows, least, share=50, top=2000):
    f, n = grams(rows)
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in candidates.items():
            if len(p) == 3:
                covered |= {q for q in (p[:2], p[1:]) if 100 * a >= share * counts[q]}
        found = []
        for p, a in candidates.items():
            if p in covered:
                continue
            score, _, left, right = min(
                (10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                for k in range(1, len(p))
            )
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("range_bytes", "least"), [(1 << 24, 10), (20_000, 3), (3_000, 10)])
def test_against_brute_force(spark, rows, range_bytes, least):
    """One range, and many that end within frequent words."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    expected = brute([(r.text, r.lang) for r in docs.collect()], least)
    assert len(expected) > 150
    assert rows(co.collocations(docs, least=least, range_bytes=range_bytes)) == expected


def test_small_blocks_and_early_sending(spark, rows, monkeypatch):
    texts = ["a b c a b c, a b d. the the the the", "a b c; x y A B", None, "b c b c b c"] * 4
    langs = ["en", None, "en", "fr"] * 4
    monkeypatch.setattr(co, "ARCS", 5)
    monkeypatch.setattr(co, "BLOCK", 1)
    docs = spark.createDataFrame(list(zip(texts, langs, strict=True)), "text string, lang string").coalesce(1)

    class Docs:
        """Runs the function that Spark would, here, with the small sizes."""

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return list(run(iter(docs.toArrow().to_batches())))

    sent = co.sent_shards(Docs(), [("en", "b"), ("fr", "b", "c")])
    assert {r.column("range")[0].as_py() for r in sent} == {0, 1, 2} and len(sent) > 6
    whole = co.united([co.Automaton.read(r.column("blob")[0].as_py()) for r in sent])
    f, n = grams(zip(texts, langs, strict=True))
    assert listed(whole) == {(lang, *p): c for lang in f for p, c in f[lang].items()} | {(k,): v for k, v in n.items()}
    assert rows(co.collocations(docs, least=2)) == brute(list(zip(texts, langs, strict=True)), 2)


def listed(automaton):
    words, out = automaton.words.to_pylist(), {}
    for level in range(co.LEVELS):
        arcs = np.flatnonzero(automaton.weights[level])
        for gram, w in zip(np.stack(automaton.path(level, arcs), axis=1).tolist(), automaton.weights[level][arcs], strict=True):
            out[tuple(words[i] for i in gram)] = int(w)
    return out


def test_automata():
    texts = pa.array(["b a b a c", "a b a", "zz. zz zz", "é a é a", "", None])
    langs = pa.array(["x", "y", "x", "y", "x", "x"])
    whole = co.counted(texts, langs)
    f, n = grams(zip(texts.to_pylist(), langs.to_pylist(), strict=True))
    expected = {(lang, *p): c for lang in f for p, c in f[lang].items()} | {(k,): v for k, v in n.items()}
    assert listed(whole) == expected
    assert listed(co.Automaton.read(whole.written())) == expected
    assert listed(co.united([whole, co.counted(texts[:2], langs[:2]), whole]))[("x", "a", "b")] == 3
    bounds = [("x", "a", "c"), ("x", "b", "a", "b"), ("y",), ("y", "b", "a"), ("zzz", "a")]
    parts = list(co.united([whole]).cut(bounds))
    merged = {}
    for number, part in parts:
        one = listed(co.Automaton.read(part.written()))
        low, high = bounds[number - 1] if number else (), bounds[number] if number < len(bounds) else ("\U0010ffff",)
        assert all(low <= gram < high for gram in one)
        merged |= one
    assert merged == expected
    asked = co.counted(pa.array(["a c q a b"]), pa.array(["x"]))
    found = whole.locate(asked)
    known = {g: i for i, g in enumerate(zip(*[x.tolist() for x in asked.path(1, np.arange(len(asked.labels[1])))], strict=True))}
    for (_, word), i in known.items():
        spelled = asked.words[word].as_py()
        at = found[1][i]
        assert (at >= 0) == (("x", spelled) in expected)
        assert at < 0 or whole.weights[1][at] == expected[("x", spelled)]


def test_large_counts_are_exact():
    """Counts whose products pass 64 bits."""
    own = co.counted(pa.array(["p q"]), pa.array(["en"]))
    own.weights[2][:] = 3 * 10**12 + 7
    known = co.counted(pa.array(["p q"]), pa.array(["en"]))
    known.weights[1][:] = 5 * 10**12 + 1
    rows = co._best(own, np.zeros(1, np.int64), known, 50, 10)
    a, part = 3 * 10**12 + 7, 5 * 10**12 + 1
    assert rows == [("en", "p q", a, part, part, 2, 10**6 * a * a // (part * part))]


def test_odd_rows(odd_docs, no_docs, spark, rows):
    expected = brute([(r.text, r.lang) for r in odd_docs.collect()], 2)
    assert rows(co.collocations(odd_docs, least=2)) == expected and expected
    assert co.collocations(no_docs).count() == 0
    alone = spark.createDataFrame([("only one",)] * 3, "text string").selectExpr("text", "cast(null as string) lang")
    assert co.collocations(alone).count() == 0
