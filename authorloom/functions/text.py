"""Text clean-up, counting and tokens as native expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from authorloom.functions import patterns as P


def collapse_ws(text: Column) -> Column:
    """Any run of white space becomes one blank; both ends are stripped."""
    return F.trim(F.regexp_replace(text, P.java(P.WHITESPACE_RUN), " "))


def _where_held(text: Column, marks: Iterable[str], change: Callable[[Column], Column]) -> Column:
    """``change`` where the text holds one of ``marks``, without which its pattern finds nothing; a plain search for
    them is cheaper. The text is bound to a name, so that steps within steps are not written out again."""

    def run(bound: Column) -> Column:
        held = reduce(or_, [F.contains(bound, F.lit(mark)) for mark in marks])
        return F.when(held, change(bound)).otherwise(bound)

    return F.transform(F.array(text), run)[0]


def remove_image_tag(text: Column) -> Column:
    return F.replace(text, F.lit(P.IMAGE_TAG), F.lit(""))


def remove_links(text: Column, greedy: bool = True) -> Column:
    """Drop ``[label](target)``; greedy reaches from the first ``[`` to the last ``)``."""
    pattern = P.java(P.LINK_GREEDY if greedy else P.LINK_EACH)
    return _where_held(text, "[", lambda held: F.regexp_replace(held, pattern, ""))


def remove_mentions(text: Column, strict: bool = False) -> Column:
    """Drop community and account mentions; strict asks for a word boundary before."""
    pattern = P.java(P.MENTION_STRICT if strict else P.MENTION, True)
    return _where_held(text, "/", lambda held: F.regexp_replace(held, pattern, ""))


def remove_spoilers(text: Column) -> Column:
    return _where_held(text, P.SPOILER.split("|"), lambda held: F.regexp_replace(held, P.java(P.SPOILER), ""))


def remove_age_gender(text: Column) -> Column:
    return _where_held(text, "(", lambda held: F.regexp_replace(held, P.java(P.AGE_GENDER, True), ""))


def clean_text(text: Column, greedy: bool = True, strict: bool = False) -> Column:
    """All rewriting steps in order, ending with normalised white space."""
    text = remove_links(remove_image_tag(text), greedy)
    text = remove_spoilers(remove_mentions(text, strict))
    return collapse_ws(remove_age_gender(text))


def char_count(text: Column) -> Column:
    """Length in code points."""
    return F.length(text).cast("int")


def word_count(text: Column) -> Column:
    """Number of words separated by white space."""
    return F.regexp_count(text, F.lit(P.java(P.WORD_RUN))).cast("int")


def flat_word_count(text: Column) -> Column:
    """The same for a text that :func:`collapse_ws` left: one more than its blanks."""
    blanks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text == "", 0).otherwise(blanks + 1).cast("int")


def has_words(text: Column) -> Column:
    """Is there anything but white space? False for a missing text."""
    return F.coalesce(text.rlike(f"[^{P.SPACE}]"), F.lit(False))


def accent_table() -> tuple[str, str, dict[str, str]]:
    """Characters with an ASCII decomposition: one-to-one pairs and longer ones.

    Derived from the Unicode decompositions of the Latin blocks, the ligatures,
    the full-width forms and general punctuation.
    """
    sources, targets, longer = [], [], {}
    blocks = [(0x00A0, 0x0250), (0x1E00, 0x1F00), (0x2000, 0x2070), (0xFB00, 0xFB07), (0xFF01, 0xFF5F)]
    for start, stop in blocks:
        for point in range(start, stop):
            char = chr(point)
            if char != char.lower():
                continue
            plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
            if not plain or plain == char:
                continue
            if len(plain) == 1:
                sources.append(char)
                targets.append(plain)
            elif plain.isalnum():
                longer[char] = plain
            else:
                sources.append(char)
                targets.append(plain[0])
    return "".join(sources), "".join(targets), longer


def strip_accents(text: Column) -> Column:
    """Map to ASCII letters where a decomposition exists and drop the rest."""
    sources, targets, longer = accent_table()
    for char, plain in longer.items():
        text = F.replace(text, F.lit(char), F.lit(plain))
    return F.regexp_replace(F.translate(text, sources, targets), r"[^\x00-\x7F]", "")


def english_stop_words() -> list[str]:
    """Spark ML's English list; pass your own list where another is wanted."""
    return StopWordsRemover.loadDefaultStopWords("english")


def tokenize(
    text: Column, stop_words: Iterable[str] = (), accents: bool = False
) -> Column:
    """Lower-case words of two or more characters, stop words left out."""
    text = F.lower(text)
    if accents:
        text = strip_accents(text)
    tokens = F.regexp_extract_all(text, F.lit(P.java(P.TOKEN)), F.lit(0))
    stop = sorted(set(stop_words))
    if stop:
        tokens = F.filter(tokens, lambda word: ~word.isin(stop))
    return tokens
