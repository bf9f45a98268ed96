import hashlib
import random
from collections import Counter

import pytest

from odd_tables import no_docs, odd_docs  # noqa: F401
from authorloom.llm import suffix_dedup


def brute(docs, length):
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for p in range(len(t)) if gone[p] and not (p and gone[p - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [piece(rng.randint(30, 120)) for _ in range(6)]
    docs = []
    for i in range(50):
        parts = [piece(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared)
            a, b = sorted((rng.randint(0, len(s)), rng.randint(0, len(s))))
            parts += [s[a:b] if rng.random() < 0.5 else s, piece(rng.randint(0, 40))]
        docs.append((i, "".join(parts)))
    return docs + [(50, "ab" * 200), (51, "xyz" * 100), (52, docs[7][1]), (53, None), (54, "")]


@pytest.mark.parametrize("batches, many", [(1, 5000), (2, 5000), (5, 2)])
def test_same_bytes_as_a_count_of_all_strings(spark, batches, many):
    docs = corpus(batches)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix_dedup.digests(suffix_dedup.remove_repeats(df, 40, 12, batches, many)).collect()
    assert sorted(map(tuple, got)) == brute(docs, 40)


def test_levels_merge_geometrically(spark):
    df = spark.createDataFrame(corpus(3), "doc_id long, text string")
    index = suffix_dedup.SuffixIndex(spark, 40, 12)
    sizes = []
    for i in range(5):
        index.add(suffix_dedup.anchored_runs(df.where(f"doc_id % 5 = {i}"), 40, 12))
        sizes.append([size for size, _ in index.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]


def test_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(odd_docs).collect()}
    assert got[1].n_bytes == 0 and got[2].kept == b"" and got[3].n_removed == got[3].n_bytes
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
