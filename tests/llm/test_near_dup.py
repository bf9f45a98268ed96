import random
import re

import numpy as np
from pyspark.sql import functions as F

from odd_tables import no_docs, odd_docs  # noqa: F401
from authorloom.llm import near_dup, shared
from authorloom.llm.components import components


def brute(docs):
    """Component per doc_id from all pairs of full shingle sets."""
    sets = {}
    for i, text in docs:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 85 * len(a | b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def family(seed=5, n=60):
    """A chain of texts, each a small edit of one before it, so that the ends differ much."""
    rng = random.Random(seed)
    words = [f"w{rng.randint(0, 999)}" for _ in range(300)]
    texts = [" ".join(words)]
    for _ in range(n - 1):
        words = list(rng.choice(texts).split())
        for _ in range(rng.randint(1, 12)):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
        texts.append(" ".join(words))
    return list(enumerate(texts + [texts[3], texts[3].upper(), "a b", "A b", ""]))


def test_same_groups_as_all_pairs(spark):
    docs = family()
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_of_a_hot_band(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    docs = family(9, 40)
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)


def test_odd_rows(odd_docs, no_docs):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(odd_docs).collect())
    assert got[:2] == [(1, 0, 1), (2, 0, 2)]
    assert got[3:6] == [(4, 1, 4), (4, 1, 4), (5, 1, 4)]
    assert near_dup.near_duplicates(no_docs).count() == 0
    kept = near_dup.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7]


def test_rows_without_id_stay(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert near_dup.keep_first(docs).count() == 3


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 91: 90}
    assert components(links.where("false")).count() == 0


def near_group(spark, n, outliers=0):
    """A band with ``n`` equal signatures, each a component of its own, and others unlike all."""
    same = bytes(64)
    rows = [(1, i, i, same) for i in range(n)]
    rows += [(1, n + i, n + i, bytes(random.Random(i).randbytes(64))) for i in range(outliers)]
    return spark.createDataFrame(rows, "key long, doc_id long, component long, signature binary")


def test_rows_dealt_and_joined_grow_with_the_group(spark, monkeypatch):
    """Not with its square: a band of many blocks, with and without members unlike the rest."""
    monkeypatch.setattr(near_dup, "BLOCK", 250)
    for n in (1000, 2000, 4000):
        members = near_group(spark, n, outliers=20).withColumn("weight", F.lit(1 / 250))
        dealt = near_dup.dealt_once(members, "key")
        assert dealt.count() == n + 20

        def alike(unit, component):
            signature = np.frombuffer(b"".join(unit.column("signature").to_pylist()), np.uint8)
            return near_dup._spanning(signature.reshape(len(component), -1), component, 0.8)

        assert near_dup.joined_components(dealt, "key", alike).count() < n
        contracted = members.withColumn("component", F.when(F.col("component") < n, 0).otherwise(F.col("component")))
        assert near_dup.dealt_all(contracted, "key").count() <= n + 20 * (n // 250 + 3)
        clusters = near_dup.likely_clusters(near_group(spark, n, 20), 0.8).collect()
        assert {(r.component, r.cluster) for r in clusters} == {(i, 0) for i in range(n)}


def test_all_pairs_of_different_components_meet(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([0, 0, 0, i]), b"", 0.2) for k in (1, 2) for i in range(60)]
    members = spark.createDataFrame(rows, "key long, doc_id long, component long, signature binary, weight double")
    units = {}
    for r in near_dup.dealt_all(members, "key").collect():
        units.setdefault((r.key, r.i, r.j), []).append(r)
    met = {(k, x.doc_id, y.doc_id) for (k, _, _), unit in units.items() for x in unit for y in unit}
    apart = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2]}
    assert apart <= met


def test_groups_in_many_blocks_of_text(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    monkeypatch.setattr(near_dup, "UNIT_BYTES", 9000)
    for seed in (3, 11):
        docs = family(seed, 70)
        got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)


def test_filter_of_ids_never_misses(spark, monkeypatch):
    ids = spark.range(0, 30_000, 7).select(F.col("id").alias("doc_id"))
    docs = spark.range(30_000).select(F.col("id").alias("doc_id")).union(spark.sql("select cast(null as bigint)"))
    for words, most in ((1 << 17, 50), (8, 30_000)):
        monkeypatch.setattr(shared, "FILTER_WORDS", words)
        flagged = [r.doc_id for r in shared.maybe_among(docs, ids, "doc_id").where("_maybe").collect()]
        missed = set(range(0, 30_000, 7)) - set(flagged)
        assert not missed and len(flagged) < 30_000 // 7 + most
    assert shared.maybe_among(docs, ids.where("false"), "doc_id").where("_maybe").count() == 0
