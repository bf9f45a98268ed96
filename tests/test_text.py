"""Text functions against Python's own regex and hash modules."""

import hashlib
import hmac
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from authorloom.functions import text as X
from authorloom.functions.hashing import order_key, pseudonym
from authorloom.functions.phrases import compile_phrases

CASES = [
    "x [a](u) mid [b](v) y",
    "her/him",
    "R/Topic/x and u/Some_User here",
    ">!a!<",
    ">>!!",
    "(25 F) (M30) (nb 22) (41) (?) (? 7) (12 non-binary)",
    "a b\tc\n\nd e\x1cf",
    "   ",
    "",
    "<image> text <IMAGE>",
    "naïve café ßtraße 日本語 Ünïted",
    "[a]\n(b) [c](d\n)",
    "[no link] (31 male)",
]


def apply(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def without_links(text):
    """Each line loses what lies between its first link-like bracket and its last parenthesis."""
    lines = text.split("\n")
    for n, line in enumerate(lines):
        end = line.rfind(")")
        for start in (i for i, c in enumerate(line) if c == "["):
            if -1 < line.find("](", start + 1, end) < end - 1:
                lines[n] = line[:start] + line[end + 1 :]
                break
    return "\n".join(lines)


def without_mentions(text):
    out, i = "", 0
    while i < len(text):
        stop = i + 2
        while text[i : i + 2].lower() in ("r/", "u/") and stop < len(text) and text[stop] != "/" and not text[stop].isspace():
            stop += 1
        out, i = (out, stop) if stop > i + 2 else (out + text[i], i + 1)
    return out


def without_spoilers(text):
    out, i = "", 0
    while i < len(text):
        mark = text[i : i + 2] in (">!", "!<")
        out, i = (out, i + 2) if mark else (out + text[i], i + 1)
    return out


PYTHON = {
    "collapse_ws": (X.collapse_ws, lambda t: " ".join(t.split())),
    "links": (X.remove_links, without_links),
    "mentions": (X.remove_mentions, without_mentions),
    "spoilers": (X.remove_spoilers, without_spoilers),
    "image": (X.remove_image_tag, lambda t: t.replace("<image>", "")),
    "chars": (X.char_count, len),
    "words": (X.word_count, lambda t: len(t.split())),
    "has_words": (X.has_words, lambda t: t.strip() != ""),
    "tokens": (X.tokenize, lambda t: re.findall(r"\b\w\w+\b", t.lower())),
}


@pytest.mark.parametrize("name", PYTHON)
def test_matches_python(spark, name):
    fn, expected = PYTHON[name]
    assert apply(spark, fn, CASES) == [expected(t) for t in CASES]


@pytest.mark.parametrize(
    "fn, given, expected",
    [
        (X.remove_links, "x [a](u) mid [b](v) y", "x  y"),
        (X.remove_links, "[a]\n(b) [c](d\n)", "[a]\n(b) [c](d\n)"),
        (X.remove_mentions, "her/him", "he"),
        (X.remove_mentions, "R/Topic/x and u/Some_User here", "/x and  here"),
        (X.remove_spoilers, ">!a!< >>!!", "a >!"),
        (X.remove_age_gender, "a (25 F) b(M30)c", "a  bc"),
        (X.remove_age_gender, "(nb 22)(41)(12 non-binary)(31 male)(? 7)", ""),
        (X.remove_age_gender, "(?) (F) (1 2) (25 F", "(?) (F) (1 2) (25 F"),
    ],
)
def test_rewrites_by_hand(spark, fn, given, expected):
    assert apply(spark, fn, [given]) == [expected]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab ru/()[]>!<25FM\t\n \x1f é", max_size=30), min_size=1, max_size=40))
def test_random_texts_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    names = [n for n in PYTHON if n != "tokens"]
    got = df.orderBy("i").select(*[PYTHON[n][0](F.col("t")).alias(n) for n in names]).collect()
    for row, text in zip(got, texts):
        assert list(row) == [PYTHON[n][1](text) for n in names], text


def test_clean_order(spark):
    got = apply(spark, X.clean_text, ["x [a](u) mid [b](v) y", "  >!a!<  (25 F) r/Topic b"])
    assert got == ["x y", "a b"]


def test_gentle_options(spark):
    assert apply(spark, lambda c: X.remove_links(c, greedy=False), ["x [a](u) mid [b](v) y"]) == ["x  mid  y"]
    assert apply(spark, lambda c: X.remove_mentions(c, strict=True), ["her/him u/me"]) == ["her/him "]


def test_whitespace_is_idempotent(spark):
    once = apply(spark, X.collapse_ws, CASES)
    assert apply(spark, X.collapse_ws, once) == once


def test_strip_accents(spark):
    got = apply(spark, lambda c: X.strip_accents(F.lower(c)), ["Café ÀÉÎ", "ﬁn a…b", "日本 ok"])
    assert got == ["cafe aei", "fin a.b", " ok"]


def test_stop_words(spark):
    assert apply(spark, lambda c: X.tokenize(c, ["the"]), ["The cat a The dog"]) == [["cat", "dog"]]
    assert "the" in X.english_stop_words()


def test_pseudonym_is_hmac(spark):
    names = ["alice", "Bob", "señor", "x" * 100]
    for key in ("secret", "k" * 80):
        expected = [hmac.new(key.encode(), n.encode(), hashlib.sha256).hexdigest()[:16] for n in names]
        assert apply(spark, lambda c: pseudonym(c, key), names) == expected
    assert apply(spark, lambda c: pseudonym(c, "secret"), ["alice", "", None]) == ["4360c67bc8102511", None, None]


def test_order_key(spark):
    expected = hashlib.sha256(b"22:abc").hexdigest()
    assert apply(spark, lambda c: order_key(22, c), ["abc"]) == [expected]


def test_phrases(spark):
    pattern = compile_phrases(
        ["I was diagnosed with migraine", "? helps my migraine", "I have ? migraine"],
        "migraine",
        ["migraine", "cluster headache"],
    )
    cases = {
        "Last year I was DIAGNOSED with Migraine!": True,
        "i was diagnosed with cluster headache": True,
        "I have really migraine": True,
        "I have well-known migraine": True,
        "they have migraine": False,
        "I was diagnosed with migraines": False,
        "xI was diagnosed with migraine": False,
        "aspirin helps my migraine": True,
        "helps my migraine": False,
        "'t helps my migraine": True,
        "éI was diagnosed with migraine": False,
        "": False,
    }
    assert apply(spark, pattern.search, list(cases)) == list(cases.values())
    assert apply(spark, pattern.search, [None]) == [False]


def test_phrases_agree_with_python(spark):
    phrases = ["my foo", "foo? yes", "I'm foo-ish", "got ? by foo", "c++ foo", "no name here"]
    pattern = compile_phrases(phrases, "foo", ["foo", "f o"])
    branches = []
    for phrase in phrases:
        escaped = re.escape(phrase.lower().replace("foo", "{{C}}"))
        escaped = escaped.replace(r"\?", r"[\w'-]+").replace(re.escape("{{C}}"), "(?:foo|f o)")
        branches.append(rf"\b{escaped}\b")
    python = re.compile("|".join(branches), re.I)
    texts = [
        "my foo", "My F O.", "my food", "foo's yes", "foox yes", "I'm foo-ish", "got bitten by foo", "c++ foo",
        "xc++ foo", "no name here", "no names here", "got - by foo", "amy foo",
    ]
    assert apply(spark, pattern.search, texts) == [bool(python.search(t)) for t in texts]
