import random
import time
from functools import reduce

import pytest
from pyspark.sql import functions as F

from authorloom.functions.phrases import compile_phrases

NAMES = ["migraine", "cluster headache", "cluster-head", "MS"]
WORDS = "i was am have had been diagnosed with my ? migraine doctor says it's ? help helps the a an so-called".split()


def phrase_list(n, seed=1):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        words = [rng.choice(WORDS) for _ in range(rng.randint(2, 6))]
        words += [rng.choice(["", f"w{rng.randint(0, 3000)}", "(really)", "100%"])]
        out.add(" ".join(words).strip())
    return sorted(out)


def texts(phrases, n=400, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice([*WORDS, "xyz", "migraines", "cluster headache", "It's", "élan", "well,"]) for _ in range(25)]
        if i % 3 == 0:
            phrase = rng.choice(phrases).replace("migraine", rng.choice(NAMES)).replace("?", rng.choice(["Bob's", "x-y", "7"]))
            place = rng.randint(0, 25)
            words[place:place] = [rng.choice(["", "x", "("]) + phrase.upper() + rng.choice(["", "s", ".", "'"])]
        rows.append((i, " ".join(words)))
    return rows


def hits(spark, rows, search):
    df = spark.createDataFrame(rows, "id int, text string")
    return {r.id for r in df.where(search(F.col("text"))).collect()}


@pytest.mark.parametrize("n", [1, 12, 195])
def test_same_hits_as_every_phrase_alone(spark, n):
    phrases = phrase_list(n)
    rows = texts(phrases)
    alone = [compile_phrases([p], "migraine", NAMES) for p in phrases]
    expected = hits(spark, rows, lambda t: reduce(lambda a, b: a | b, [p.search(t) for p in alone]))
    together = compile_phrases(phrases, "migraine", NAMES)
    assert hits(spark, rows, together.search) == expected
    assert 0 < len(expected) < len(rows)


def test_five_thousand_phrases(spark):
    """The same hits as in parts of 250 phrases; 25 times the phrases cost far less than 25 times the time."""
    phrases = phrase_list(5000)
    rows = texts(phrases, 3000)
    whole, few = compile_phrases(phrases, "migraine", NAMES), compile_phrases(phrases[:200], "migraine", NAMES)
    found = set()
    for begin in range(0, 5000, 250):
        found |= hits(spark, rows[:600], compile_phrases(phrases[begin : begin + 250], "migraine", NAMES).search)
    assert hits(spark, rows[:600], whole.search) == found

    def seconds(pattern):
        start = time.perf_counter()
        hits(spark, rows, pattern.search)
        return time.perf_counter() - start

    seconds(few), seconds(whole)
    assert min(seconds(whole) for _ in range(3)) < 12 * min(seconds(few) for _ in range(3))


def test_no_phrases_and_phrases_within_phrases(spark):
    rows = [(0, "i have migraine"), (1, "i have"), (2, "i have migraines"), (3, ""), (4, None)]
    assert hits(spark, rows, compile_phrases([], "migraine", []).search) == set()
    assert hits(spark, rows, compile_phrases(["", "i have migraine", "i have"], "migraine", []).search) == {0, 1, 2}
    assert hits(spark, rows, compile_phrases(["i have ?"], "migraine", []).search) == {0, 2}
    assert hits(spark, rows, compile_phrases(["have migraine", "i have migraine"], "migraine", []).search) == {0}
