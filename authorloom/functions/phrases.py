"""Self-report phrases compiled to one regular expression."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from authorloom.functions import patterns as P

_W = f"[{P.WORD}]"
# Boundary before or after anything, as a look-around pair.
_EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


# Letters that Java takes for k, s and i where case does not count.
_MORE_CASES = {"k": "\u212a", "s": "\u017f", "i": "\u0130\u0131"}


def _first_letters(starts: set[str]) -> str:
    """A look at the next letter, which is cheaper than trying the phrases at every place; empty if any may come."""
    if not starts or not all(c.isascii() and c.isalnum() for c in starts):
        return ""
    return "(?=[" + "".join(sorted({x for c in starts for x in c.lower() + c.upper() + _MORE_CASES.get(c.lower(), "")})) + "])"


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


@dataclass(frozen=True)
class PhrasePattern:
    """``full`` decides; ``guard`` is a cheap test that every hit passes."""

    full: str
    guard: str

    def search(self, text: Column) -> Column:
        """Boolean: does the text hold any phrase? False for a missing text."""
        hit = text.rlike(self.guard) & text.rlike(self.full)
        return F.coalesce(hit, F.lit(False))


class _Trie:
    """Phrases by their common beginnings; a step is one letter or a whole sub-pattern."""

    def __init__(self) -> None:
        self.next: dict[str, _Trie] = {}
        self.ends: dict[str, None] = {}

    def add(self, steps: Iterable[str], end: str = "") -> None:
        node = self
        for step in steps:
            node = node.next.setdefault(step, _Trie())
        node.ends[end] = None

    def pattern(self) -> str:
        """Alternatives are written out where phrases part, so a text is tried once for each beginning, not for
        each phrase; runs without a parting are plain text."""
        branches: list[tuple[str, _Trie]] = sorted(self.next.items())
        options = []
        for step, node in branches:
            text = step
            while len(node.next) == 1 and not node.ends:
                ((step, node),) = node.next.items()
                text += step
            options.append(text + node.pattern())
        options += self.ends
        if len(options) == 1:
            return options[0]
        return "(?:" + "|".join(options) + ")"


def compile_phrases(
    phrases: Iterable[str], condition: str, synonyms: Iterable[str]
) -> PhrasePattern:
    """Whole-word, case-blind search for phrases, factored by their beginnings.

    The condition's name stands for any of its synonyms, ``?`` for one word of
    letters, digits, apostrophes and hyphens. Empty phrases do not count; without phrases nothing is found.
    """
    condition, synonyms = condition.lower(), list(synonyms)
    names = _Trie()
    for spelling in sorted(set(synonyms) | {condition}):
        names.add(re.escape(c) for c in spelling)
    named = names.pattern()
    heads: dict[str, _Trie] = {}
    guards = _Trie()
    starts: set[str] = set()
    for phrase in dict.fromkeys(p.lower() for p in phrases if p):
        steps: list[str] = []
        literals: list[str] = []
        pieces = re.split(f"({re.escape(condition)}|\\?)", phrase)
        for piece in pieces:
            if piece == condition:
                steps.append(named)
            elif piece == "?":
                steps.append(f"[{P.WORD}'-]+")
            else:
                steps += [re.escape(c) for c in piece]
                literals.append(piece)
        head = f"(?<!{_W})" if _is_word(phrase[0]) else _EDGE
        tail = f"(?!{_W})" if _is_word(phrase[-1]) else _EDGE
        heads.setdefault(head, _Trie()).add(steps, tail)
        if condition in pieces:
            guards.add([named])
            starts |= {spelling[:1] for spelling in {*synonyms, condition}}
        else:
            literal = max(literals, key=len, default="")
            guards.add(re.escape(c) for c in literal)
            starts.add(literal[:1])
    if not heads:
        return PhrasePattern("(?!)", "(?!)")
    full = "(?iu)(?:" + "|".join(head + trie.pattern() for head, trie in heads.items()) + ")"
    return PhrasePattern(full, _first_letters(starts) + "(?iu)" + guards.pattern())
