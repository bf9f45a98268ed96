import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from odd_tables import SMALL, no_docs, odd_docs  # noqa: F401
from authorloom.llm import frequent, token_align

FILES = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")))


@pytest.fixture(scope="module")
def known():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def brute(known, text):
    """Groups of (A ids, B ids) by comparing every byte offset."""
    a, b = known
    if not text:
        return []
    one, two = token_align.tokenizers(*FILES)
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)

    def spelled(spelling, i):
        return bytes(spelling.data[spelling.starts[i] : spelling.starts[i] + spelling.lengths[i]])

    bytes_a, bytes_b = [spelled(one.spelling, i) for i in ids_a], [spelled(two.spelling, i) for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    ends_a, ends_b = list(itertools.accumulate(map(len, bytes_a))), list(itertools.accumulate(map(len, bytes_b)))
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((ids_a[i:x], ids_b[j:y]))
        i, j = x, y
    return groups


def expected(known, docs):
    every = [brute(known, d.text) for d in docs]
    linked = [Counter(p for a, b in groups for p in itertools.product(a, b)) for groups in every]
    counts = Counter(p for one in linked for p in one)
    highest = defaultdict(int)
    for (a, _), c in counts.items():
        highest[a] = max(highest[a], c)
    out = []
    for doc, groups, own in zip(docs, every, linked, strict=True):
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append(
            (
                doc.doc_id,
                sum(len(a) for a, _ in groups),
                sum(len(b) for _, b in groups),
                len(groups),
                sum(own.values()),
                sum(n for p, n in own.items() if counts[p] == highest[p[0]]),
                sum(n * counts[p] for p, n in own.items()),
                hashlib.sha256(line.encode()).hexdigest() if groups else "",
            )
        )
    return sorted(out, key=repr)


@pytest.mark.parametrize("keys", [1 << 16, 100, 1])
def test_against_brute_force(spark, known, rows, monkeypatch, keys):
    monkeypatch.setattr(frequent.least_count, "__defaults__", (keys,))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 6000 or text is null")
    assert rows(token_align.alignment(docs, *FILES)) == expected(known, docs.collect())


def test_odd_rows(spark, known, rows, odd_docs, no_docs):
    short = odd_docs.where("doc_id != 3")
    assert rows(token_align.alignment(short, *FILES)) == expected(known, short.collect())
    long = token_align.alignment(odd_docs.where("doc_id = 3"), *FILES).first()
    assert long.n_a > 20_000 and long.n_links >= long.n_groups > 0
    assert token_align.alignment(no_docs, *FILES).count() == 0


def test_whole_groups_leave_the_operator(spark, known, odd_docs):
    for row in token_align.align(odd_docs.where("doc_id != 3"), *FILES, groups=True).collect():
        text = next(d.text for d in odd_docs.collect() if d.doc_id == row.doc_id)
        cuts = list(zip([0, *row.a_cuts], row.a_cuts, [0, *row.b_cuts], row.b_cuts, strict=False))
        assert [(row.a_ids[w:x], row.b_ids[y:z]) for w, x, y, z in cuts] == brute(known, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=60))
def test_common_ends(one, two):
    total = max(sum(one), sum(two)) + 1
    a = [*itertools.accumulate(one), total]
    b = [*itertools.accumulate(two), total]
    both = sorted(set(a) & set(b))
    x, y = token_align.common_ends(a, b)
    assert (x.tolist(), y.tolist()) == ([a.index(e) + 1 for e in both], [b.index(e) + 1 for e in both])


def test_long_stretches_are_skipped():
    """Ten times the stretch costs far less than ten times the comparisons; results stay whole."""
    n = 200_000
    x, y = token_align.common_ends(list(range(1, n)), list(range(1, n)))
    assert x.tolist() == y.tolist() == list(range(1, n))
    ends = [*range(1, 1000), 2000, *range(2001, 3000)]
    other = [*range(1, 1000), 1500, 2000, *range(2001, 3000)]
    x, y = token_align.common_ends(ends, other)
    assert x.tolist() == list(range(1, 2000)) and y.tolist() == [*range(1, 1000), *range(1001, 2001)]


def test_links_of_large_groups_in_parts(known, monkeypatch):
    text = "\U0001f3f4\U0001f9d1 漢字漢字仮名 supercalifragilistic ĳſ  \n\n\n  x"
    a, b = token_align.tokenizers(*FILES)
    whole = token_align.Block([text, None, text * 3], a, b).pairs()
    monkeypatch.setattr(token_align, "LINKS", 2)
    assert all(np.array_equal(x, y) for x, y in zip(whole, token_align.Block([text, None, text * 3], a, b).pairs(), strict=True))


def test_both_libraries_agree_on_the_letters_left_to_the_faster(known):
    coder = token_align.ByteTokens(FILES[0], FILES[2])
    letters = [chr(i) for i in range(0x2070) if not token_align._OTHER.match(chr(i))]
    for c in letters:
        text = f" a{c}b {c}{c} 1{c}2{c} '{c}s {c}\n{c}"
        assert coder.encode(text).tolist() == known[0].encode(text, add_special_tokens=False).ids, hex(ord(c))
    assert coder.encode("<|endoftext|>").tolist() == known[0].encode("<|endoftext|>", add_special_tokens=False).ids
