import hashlib
import random
import re

from odd_tables import no_docs, odd_docs  # noqa: F401
from authorloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = tokens(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = tokens(text), set(), set()
        for window, names in windows.items():
            n = len(window)
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == window:
                    hit.update(range(i, i + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def tables(seed=1):
    rng = random.Random(seed)
    words = ["Aa", "bb", "été", "c3", "dd", "e"]
    say = lambda n: " ".join(rng.choice(words) + rng.choice(["", ".", ", -"]) for _ in range(n))
    items = [(i, say(rng.randint(10, 40))) for i in range(12)] + [(20, "bb zz"), (21, ""), (22, None), (23, "...")]
    docs = []
    for i in range(40):
        cut = rng.choice(items)[1] or ""
        docs.append((i, say(rng.randint(0, 60)) + " " + (cut if rng.random() < 0.6 else "") + " " + say(20)))
    return docs + [(90, None), (91, ""), (92, "bb ZZ bb zz")], items + [items[0]]


def test_same_as_search_of_every_window(spark, monkeypatch):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    assert sorted(map(tuple, decontam.contamination(d, b).collect())) == expected
    kept = {r.doc_id for r in decontam.keep_uncontaminated(d, b).collect()}
    assert kept == {row[0] for row in expected if not row[-1]}
    monkeypatch.setattr(decontam, "TEST_BYTES", 300)  # several passes
    assert sorted(map(tuple, decontam.contamination(d, b).collect())) == expected
    assert {r.doc_id for r in decontam.keep_uncontaminated(d, b).collect()} == kept


def test_longest_match_and_its_place(spark):
    d = spark.createDataFrame([(1, "x y one two three four z"), (2, "q")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "zero one two three five")], "item_id long, text string")
    assert [tuple(r) for r in decontam.longest_matches(d, b).collect()] == [(1, "7", 3, 2)]


def test_odd_rows(spark, odd_docs, no_docs):
    b = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    got = sorted(map(tuple, decontam.contamination(odd_docs, b).collect()))
    assert [r[0] for r in got if r[-1]] == [4, 4, 5]
    assert decontam.keep_uncontaminated(odd_docs, b).columns == odd_docs.columns
    assert decontam.contamination(no_docs, b).count() == 0
    assert decontam.contamination(odd_docs, b.where("false")).where("contaminated").count() == 0


def test_longest_match_of_every_document_to_its_true_end(spark):
    """Copies in one shard each have their row, shorter matches too, and nothing is cut at a window."""
    passage = [f"p{i}" for i in range(200)]
    docs = [
        (1, " ".join(["x", *passage, "y"])),
        (2, " ".join(passage)),
        (3, " ".join(["u", "v", *passage[50:55], "w"])),
        (4, "nothing alike"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(7, " ".join(["a", *passage, "b"]))], "item_id long, text string")
    got = sorted(map(tuple, decontam.longest_matches(d, b).collect()))
    assert got == [(1, "7", 200, 1), (2, "7", 200, 0), (3, "7", 5, 2)]
    hits = {r.doc_id: r.n_hit for r in decontam.contamination(d, b).collect()}
    assert hits == {1: 200, 2: 200, 3: 0, 4: 0}


def test_longest_matches_are_those_of_all_pairs(spark):
    docs, items = tables(3)
    docs, items = docs[:12], dict(items)
    expected = {}
    for doc, text in docs:
        w = tokens(text)
        for item, other in items.items():
            v = tokens(other)
            for i in range(len(w)):
                for j in range(len(v)):
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    if n > 1:
                        expected[doc, str(item)] = min(expected.get((doc, str(item)), (0, 0)), (-n, i))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (-r.words, r.doc_word) for r in decontam.longest_matches(d, b).collect()}
    assert got == expected


def test_rows_are_judged_alike_in_several_blocks(spark, monkeypatch):
    """Null and repeated ids; a row goes for its own text only, by the hits of all blocks together."""
    monkeypatch.setattr(decontam, "TEST_BYTES", 60)
    passages = [" ".join(f"{name}{i}" for i in range(13)) for name in "abcdef"]
    b = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    bad, good = passages[0], "nothing of that kind"
    split = " ".join([passages[1], passages[2], *["fill"] * 400])  # each passage alone is below a twentieth
    rows = [(None, bad), (None, good), (1, bad), (1, good), (2, bad), (2, bad), (3, split), (4, good), (4, good)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(decontam.keep_uncontaminated(d, b).collect(), key=repr)
    assert kept == sorted(d.where(f"text = '{good}'").collect(), key=repr)
    found = decontam.contamination(d, b).collect()
    assert sorted(map(repr, ((r.doc_id, r.contaminated) for r in found))) == sorted(
        repr((i, text != good)) for i, text in rows
    )
    assert max(r.n_items for r in found) == 2
