"""Phrase collocations per language, by weighted acyclic automata of n-gram counts.

An automaton reads (language, word, word, word); every arc has a word and, as weight, how often the
n-gram that ends there occurs. Words are numbered in byte order and n-grams arrive sorted, so arcs are
appended level by level and states are finished in order; states after two words with equal arcs
are one state where an automaton is written down.

1. Each task builds the automata of its blocks of text, joins equally large ones as they come, and cuts
   the result at fixed n-grams into prefix ranges, about one for ``RANGE_BYTES`` of text.
2. One task for each range unites what all shards sent, adds the weights and keeps the n-grams that occur
   ``least`` times. A phrase is never more frequent than its parts, so nothing needed is lost.
3. For its candidates a range asks the ranges of their parts, by an automaton of all parts wanted, each once,
   however many candidates share it; its weights say how frequent the asking phrases are, from which the other range knows what is covered by a longer candidate.
4. The answer is that automaton composed with the counts; the asking range scores its candidates with it.

Frequent first words or parts thus never meet in one task: a range ends inside them, and a part is asked for
once by each range. The cutting n-grams come from a sample of the texts; they only spread the work.

Rules: null and empty texts have no words; a null language is ``und``. Texts are read whole. Repeated rows
count each. An empty table, or one without phrases that frequent, gives an empty table. Other columns, doc_id among them, are ignored.
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from authorloom.llm import shared
from authorloom.operators.ranks import top_per_group

WORDS = 3
LEVELS = WORDS + 1
RANGE_BYTES = 1 << 23
"""Bytes of text for each prefix range."""
CUTS = 64
"""Sampled n-grams for each cut."""
SAMPLE_SHARE = 0.01
SAMPLE_LEAST = 1 << 22
"""Bytes of text that are sampled at least."""
BLOCK = 1 << 20
ARCS = 1_500_000
"""Arcs that a task gathers before it sends them."""

_LOWER = shared.lower_ascii()
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_END
_WORD[[9, 32]] = False


class Automaton:
    """Weighted n-grams as levels of arcs: word, arc before it, weight.

    ``words`` are distinct and in byte order; arcs of a level are sorted by (arc before, word)."""

    def __init__(self, words: pa.Array, labels: list, parents: list, weights: list):
        self.words, self.labels, self.parents, self.weights = words, labels, parents, weights

    def __len__(self) -> int:
        return sum(map(len, self.labels))

    def keys(self, level: int) -> np.ndarray:
        return self.parents[level] * max(len(self.words), 1) + self.labels[level]

    def first(self, level: int) -> np.ndarray:
        """For each arc of ``level`` the first arc that goes on from it, and the end of the last."""
        return np.searchsorted(self.parents[level + 1], np.arange(len(self.labels[level]) + 1))

    def path(self, level: int, arcs: np.ndarray) -> list[np.ndarray]:
        """Words of the n-grams that end in some arcs, first the language."""
        out = []
        for at in range(level, -1, -1):
            out.append(self.labels[at][arcs])
            arcs = self.parents[at][arcs]
        return out[::-1]

    def locate(self, other: Automaton) -> list[np.ndarray]:
        """For every arc of another automaton the arc of the same n-gram here, or -1: both composed."""
        same = pc.index_in(other.words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = []
        for level in range(LEVELS):
            label = same[other.labels[level]].astype(np.int64) if len(other.labels[level]) else np.empty(0, np.int64)
            before = out[-1][other.parents[level]] if level else np.zeros(len(label), np.int64)
            own, wanted = self.keys(level), before * max(len(self.words), 1) + label
            at = np.searchsorted(own, wanted)
            hit = (label >= 0) & (before >= 0) & (at < len(own))
            hit[hit] = own[at[hit]] == wanted[hit]
            out.append(np.where(hit, at, -1))
        return out

    def _below(self, bound: tuple[str, ...], spelled: list[str], first: list[np.ndarray]) -> list[int]:
        """Arcs of each level whose n-grams come before ``bound``."""
        out: list[int] = []
        low, high, inside = 0, len(self.labels[0]), True
        for level in range(LEVELS):
            if level and not inside:
                out.append(int(first[level - 1][out[-1]]))
                continue
            word = bisect.bisect_left(spelled, bound[level])
            at = low + int(np.searchsorted(self.labels[level][low:high], word))
            inside = at < high and word < len(spelled) and spelled[word] == bound[level]
            inside = inside and self.labels[level][at] == word
            last = level + 1 == len(bound)
            out.append(at + (inside and not last))
            if inside and not last:
                low, high = int(first[level][at]), int(first[level][at + 1])
            else:
                inside = False
        return out

    def cut(self, bounds: list[tuple[str, ...]]) -> Iterator[tuple[int, Automaton]]:
        """(number of the prefix range, its n-grams), for ranges that have any."""
        spelled = [w.encode() for w in self.words.to_pylist()]
        first = [self.first(level) for level in range(WORDS)]
        low = [0] * LEVELS
        for number in range(len(bounds) + 1):
            end = [len(x) for x in self.labels]
            high = end if number == len(bounds) else self._below(tuple(w.encode() for w in bounds[number]), spelled, first)
            if high != low:
                yield number, self._part(low, high)
            low = high

    def _part(self, low: list[int], high: list[int]) -> Automaton:
        """Arcs from ``low`` to ``high`` with those that lead to them, which weigh nothing."""
        begin, end = list(low), list(high)
        for level in range(WORDS, 0, -1):
            if begin[level] < end[level]:
                begin[level - 1] = min(begin[level - 1], int(self.parents[level][begin[level]]))
                end[level - 1] = max(end[level - 1], int(self.parents[level][end[level] - 1]) + 1)
        labels = [x[b:e] for x, b, e in zip(self.labels, begin, end, strict=True)]
        parents = [x[b:e] - (begin[i - 1] if i else 0) for i, (x, b, e) in enumerate(zip(self.parents, begin, end, strict=True))]
        weights = []
        for level, x in enumerate(self.weights):
            own = x[begin[level] : end[level]].copy()
            own[: low[level] - begin[level]] = 0
            own[max(high[level] - begin[level], 0) :] = 0
            weights.append(own)
        return _compact(self.words, labels, parents, weights)

    def keep(self, wanted: list[np.ndarray]) -> Automaton:
        """The arcs marked in ``wanted`` and those that lead to them; unmarked ones weigh nothing."""
        used = [w.copy() for w in wanted]
        for level in range(WORDS, 0, -1):
            used[level - 1][self.parents[level][used[level]]] = True
        place = [np.cumsum(u) - 1 for u in used]
        labels = [x[u] for x, u in zip(self.labels, used, strict=True)]
        parents = [(place[i - 1][x[u]] if i else x[u]) for i, (x, u) in enumerate(zip(self.parents, used, strict=True))]
        weights = [np.where(w, x, 0)[u] for x, w, u in zip(self.weights, wanted, used, strict=True)]
        return _compact(self.words, labels, parents, weights)

    def written(self) -> bytes:
        """Compact form: fan-outs for arcs before, and equal last states once."""
        fans = [_small(np.diff(self.first(level))) for level in range(WORDS)]
        states, labels, weights = _shared_states(self.first(WORDS - 1), self.labels[WORDS], self.weights[WORDS])
        last = (_small(states), _small(np.array([len(x) for x in labels])), _join(labels), _join(weights))
        lower = [(_small(x), _small(w)) for x, w in zip(self.labels[:WORDS], self.weights[:WORDS], strict=True)]
        spelled = self.words.to_pylist()
        sizes = _small(np.array([len(w.encode()) for w in spelled]))
        return pickle.dumps(("".join(spelled).encode(), sizes, lower, fans[: WORDS - 1], last), 5)

    @classmethod
    def read(cls, blob: bytes) -> Automaton:
        data, sizes, lower, fans, (states, width, arcs, counts) = pickle.loads(blob)
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)
        words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(data))
        labels = [x.astype(np.int64) for x, _ in lower]
        weights = [w.astype(np.int64) for _, w in lower]
        width = width.astype(np.int64)
        start, states = np.cumsum(width) - width, states.astype(np.int64)
        at = shared.ranges(start[states], width[states]) if len(states) else np.empty(0, np.int64)
        labels.append(arcs.astype(np.int64)[at])
        weights.append(counts.astype(np.int64)[at])
        fans = [f.astype(np.int64) for f in fans] + [width[states] if len(states) else np.empty(0, np.int64)]
        parents = [np.zeros(len(labels[0]), np.int64), *(np.repeat(np.arange(len(f)), f) for f in fans)]
        return cls(words, labels, parents, weights)


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return _small(np.concatenate(parts) if parts else np.empty(0, np.int64))


def _shared_states(first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, list, list]:
    """(state of each arc, arcs of each state, their weights): states with equal arcs are one.

    State 0 has no arcs. Most states have one arc; those are told apart by numbers, the rest by their bytes."""
    fan = np.diff(first)
    states = np.zeros(len(fan), np.int64)
    single = np.flatnonzero(fan == 1)
    most = int(weight.max()) + 1 if len(weight) else 1
    code, place = np.unique(label[first[single]] * most + weight[first[single]], return_inverse=True)
    states[single] = place + 1
    labels = [np.empty(0, np.int64), *np.split(code // most, len(code))] if len(code) else [np.empty(0, np.int64)]
    weights = [np.empty(0, np.int64), *np.split(code % most, len(code))] if len(code) else [np.empty(0, np.int64)]
    register: dict[bytes, int] = {}
    both = np.stack([label, weight], axis=1)
    for at in np.flatnonzero(fan > 1).tolist():
        arcs = both[first[at] : first[at + 1]]
        state = register.setdefault(arcs.tobytes(), len(labels))
        if state == len(labels):
            labels.append(arcs[:, 0])
            weights.append(arcs[:, 1])
        states[at] = state
    return states, labels, weights


def _compact(words: pa.Array, labels: list, parents: list, weights: list) -> Automaton:
    """The same with only the words in use."""
    used = np.zeros(len(words), bool)
    for label in labels:
        used[label] = True
    place = np.cumsum(used) - 1
    return Automaton(words.filter(pa.array(used)), [place[x] for x in labels], parents, weights)


def _level(parent: np.ndarray, label: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parents, labels, place of each input) of the distinct arcs, sorted."""
    keys, place = np.unique(parent * max(words, 1) + label, return_inverse=True)
    return keys // max(words, 1), keys % max(words, 1), place


def _ordered(spelled: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct words in byte order, place of each input)."""
    coded = spelled.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def united(parts: list[Automaton], add: Callable = np.add) -> Automaton:
    """One automaton of all n-grams; weights of the same n-gram are added, or combined by ``add``."""
    if len(parts) == 1:
        return parts[0]
    words, rank = _ordered(pa.concat_arrays([p.words for p in parts]))
    starts = np.cumsum([0, *(len(p.words) for p in parts)])
    labels, parents, weights = [], [], []
    place: list[np.ndarray] = []
    for level in range(LEVELS):
        label = np.concatenate([rank[s + p.labels[level]] for s, p in zip(starts, parts, strict=False)])
        if level:
            before = np.concatenate([at[p.parents[level]] for at, p in zip(place, parts, strict=True)])
        else:
            before = np.zeros(len(label), np.int64)
        parent, label, where = _level(before, label, len(words))
        weight = np.zeros(len(label), np.int64)
        add.at(weight, where, np.concatenate([p.weights[level] for p in parts]))
        place = np.split(where, np.cumsum([len(p.labels[level]) for p in parts])[:-1])
        labels.append(label), parents.append(parent), weights.append(weight)
    return Automaton(words, labels, parents, weights)


class Pile:
    """Automata that are united with others of about their size, so that each is touched a few times only."""

    def __init__(self, add: Callable = np.add):
        self.parts: list[Automaton] = []
        self.add = add

    def push(self, part: Automaton) -> None:
        self.parts.append(part)
        while len(self.parts) > 1 and len(self.parts[-2]) <= 2 * len(self.parts[-1]):
            self.parts[-2:] = [united(self.parts[-2:], self.add)]

    def __len__(self) -> int:
        return sum(map(len, self.parts))

    def whole(self) -> Automaton | None:
        out = united(self.parts, self.add) if self.parts else None
        self.parts = []
        return out


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words of all texts, text of each, whether the next word is in the same piece)."""
    data, offsets = shared.utf8(texts)
    data = _LOWER[data]
    starts, ends, bounds = shared.words(data, offsets, _WORD)
    at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    kept = np.ascontiguousarray(data[_WORD[data]])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(kept)])
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    piece = np.cumsum(_END[data])[starts] if len(starts) else starts
    same = np.zeros(len(starts), bool)
    if len(starts):
        same[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    return words, text, same


def counted(texts: pa.Array, langs: pa.Array) -> Automaton:
    """Counts of all n-grams of some texts; the weight of a language is its number of words."""
    words, text, same = split_words(texts)
    coded = pc.fill_null(langs, "und").dictionary_encode()
    known = words.dictionary_encode()
    spelled, rank = _ordered(pa.concat_arrays([coded.dictionary, known.dictionary.cast(pa.string())]))
    word = rank[len(coded.dictionary) + known.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
    label = rank[coded.indices.to_numpy()][text]
    labels, parents, weights = [], [], []
    before, at = np.zeros(len(word), np.int64), np.arange(len(word))
    for level in range(LEVELS):
        parent, own, place = _level(before, label, len(spelled))
        labels.append(own), parents.append(parent), weights.append(np.bincount(place, minlength=len(own)))
        if level:
            goes_on = same[at]
            at, place = at[goes_on] + 1, place[goes_on]
        before, label = place, word[at]
    return _compact(spelled, labels, parents, weights)


def sent_shards(docs: DataFrame, bounds: list[tuple[str, ...]]) -> DataFrame:
    """(range, blob): automata of all shards, cut at ``bounds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pile = Pile()
        for block in shared.gathered(batches, BLOCK):
            pile.push(counted(block.column("text"), block.column("lang")))
            if len(pile) >= ARCS:
                yield from _pieces(pile.whole(), bounds)
                shared.give_back()
        if len(pile):
            yield from _pieces(pile.whole(), bounds)
        del pile
        shared.give_back()

    return docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "range int, blob binary")


def _pieces(whole: Automaton, bounds: list[tuple[str, ...]]) -> Iterator[pa.RecordBatch]:
    for number, part in whole.cut(bounds):
        yield _row(number, part.written())


def _row(number: int, blob: bytes, **more: object) -> pa.RecordBatch:
    given = {"range": pa.array([number], pa.int32()), "blob": pa.array([blob], pa.binary())}
    for name, value in more.items():
        given[name] = pa.array([value], pa.int32())
    return pa.RecordBatch.from_pydict(given)


def chosen_bounds(docs: DataFrame, range_bytes: int) -> list[tuple[str, ...]]:
    """Cutting n-grams, one for about ``range_bytes`` of text, evenly spread over those of a sample of texts.

    The sample is sorted by Spark; one n-gram of each stretch comes to the driver, about 30 bytes for each range."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = -(-total // range_bytes)
    if ranges < 2:
        return []
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_LEAST / total))
    # n-grams of the sample, of which one in ``thin`` takes part
    thin = max(1, int(total * share / 2) // (ranges * CUTS))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in shared.gathered(batches, BLOCK):
            some = counted(block.column("text"), block.column("lang"))
            grams = []
            for level in range(1, LEVELS):
                arcs = np.arange(len(some.labels[level]))
                mixed = shared.mix(arcs.astype(np.uint64) + np.uint64(level << 40))
                path = np.stack(some.path(level, arcs[mixed % np.uint64(thin) == 0]), axis=1)
                ends = pa.array(np.arange(len(path) + 1) * (level + 1), pa.int32())
                grams.append(pa.ListArray.from_arrays(ends, some.words.take(pa.array(path.ravel()))))
            lists = pa.concat_arrays(grams)
            yield pa.RecordBatch.from_arrays([lists], ["gram"])

    sample = docs.where(place < int(share * (1 << 30)) + 1).select("text", F.col("lang").cast("string").alias("lang"))
    grams = shared.stored(sample.mapInArrow(run, "gram array<string>"), "collocation-sample")
    every = max(1, grams.count() // ranges)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            at = np.arange(seen, seen + batch.num_rows)
            yield batch.filter(pa.array(at % every == every // 2))
            seen += batch.num_rows

    picked = grams.orderBy("gram").mapInArrow(pick, "gram array<string>").toLocalIterator()
    return sorted({tuple(r.gram) for r in picked}, key=lambda gram: [w.encode() for w in gram])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows of equal ``range``, which come one after the other."""
    from itertools import groupby

    rows = (row for batch in batches for row in _plain(batch))
    for number, own in groupby(rows, key=lambda row: row["range"]):
        yield number, own


def _plain(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def frequent_ranges(shards: DataFrame, least: int) -> DataFrame:
    """(range, blob): the n-grams of each prefix range that occur ``least`` times, with the words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _groups(batches):
            pile = Pile()
            for row in rows:
                pile.push(Automaton.read(row["blob"]))
            whole = pile.whole()
            wanted = [w >= (least if level else 1) for level, w in enumerate(whole.weights)]
            if any(w.any() for w in wanted):
                yield _row(number, whole.keep(wanted).written())
            del pile, whole, wanted
            shared.give_back()

    return shards.select("range", "blob").mapInArrow(run, "range int, blob binary")


def _wanted(own: Automaton) -> tuple[Automaton, list[np.ndarray], list[tuple[np.ndarray, list[np.ndarray]]]]:
    """(automaton of all parts of the candidates, and for phrases of two and three words: their arcs and,
    for each, the arcs of its language, its first and its last parts in that automaton).

    The weight of a part is 1 more than the most frequent candidate of three words that asks for it."""
    words = len(own.words)
    paths, asking = [], []
    for level in (2, 3):
        arcs = np.flatnonzero(own.weights[level] > 0)
        lang, *word = own.path(level, arcs)
        weight = own.weights[level][arcs] if level == 3 else np.zeros(len(arcs), np.int64)
        cuts = [(word[:k], word[k:]) for k in range(1, level)]
        paths.append((arcs, lang, cuts))
        asking.append(weight)
    # level by level: languages, single words, pairs
    langs = np.concatenate([lang for _, lang, _ in paths])
    lang_parent, lang_label, lang_place = _level(np.zeros(len(langs), np.int64), langs, words)
    labels, parents = [lang_label], [lang_parent]
    weights = [np.ones(len(lang_label), np.int64)]
    lang_of = np.split(lang_place, [len(paths[0][0])])
    parts = [(lang_of[i], side, asking[i]) for i, (_, _, cuts) in enumerate(paths) for cut in cuts for side in cut]
    first_parent, first_label, first_place = _level(
        np.concatenate([p[0] for p in parts]), np.concatenate([p[1][0] for p in parts]), words
    )
    labels.append(first_label), parents.append(first_parent)
    first_of = np.split(first_place, np.cumsum([len(p[0]) for p in parts])[:-1])
    single = np.zeros(len(first_label), np.int64)
    for place, (_, side, _) in zip(first_of, parts, strict=True):
        if len(side) == 1:
            single[place] = 1
    weights.append(single)
    pairs = [i for i, p in enumerate(parts) if len(p[1]) == 2]
    pair_parent, pair_label, pair_place = _level(
        np.concatenate([first_of[i] for i in pairs]), np.concatenate([parts[i][1][1] for i in pairs]), words
    )
    labels.append(pair_label), parents.append(pair_parent)
    most = np.zeros(len(pair_label), np.int64)
    np.maximum.at(most, pair_place, np.concatenate([parts[i][2] for i in pairs]) + 1)
    weights.append(most)
    nothing = np.empty(0, np.int64)
    labels.append(nothing), parents.append(nothing), weights.append(nothing)
    pair_of = dict(zip(pairs, np.split(pair_place, np.cumsum([len(first_of[i]) for i in pairs])[:-1]), strict=True))
    where = [(len(p[1]), pair_of.get(i, first_of[i])) for i, p in enumerate(parts)]
    candidates, at = [], 0
    for i, (arcs, _, cuts) in enumerate(paths):
        candidates.append((arcs, lang_of[i], [(where[at + 2 * k], where[at + 2 * k + 1]) for k in range(len(cuts))]))
        at += 2 * len(cuts)
    return Automaton(own.words, labels, parents, weights), lang_of, candidates


OWN, ASKED, COVER, ANSWER = range(4)


def requests(ranges: DataFrame, bounds: list[tuple[str, ...]]) -> DataFrame:
    """(range, kind, origin, blob): the parts each range wants to know, sent to the ranges that know them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _groups(batches):
            for row in rows:
                wanted, _, _ = _wanted(Automaton.read(row["blob"]))
                for target, part in wanted.cut(bounds):
                    yield _row(target, part.written(), kind=ASKED, origin=number)

    return ranges.mapInArrow(run, "range int, blob binary, kind int, origin int").select("range", "kind", "origin", "blob")


def answers(rows: DataFrame) -> DataFrame:
    """(range, kind, origin, blob): counts for those who asked, and for each range itself how frequent
    a longer candidate around each of its phrases of two words is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, group in _groups(batches):
            own, cover = None, None
            for row in group:
                if row["kind"] == OWN:
                    own = Automaton.read(row["blob"])
                    cover = np.zeros(len(own.labels[2]), np.int64)
                    continue
                asked = Automaton.read(row["blob"])
                found = own.locate(asked)
                hit = (asked.weights[2] > 0) & (found[2] >= 0)
                np.maximum.at(cover, found[2][hit], asked.weights[2][hit] - 1)
                for level in range(LEVELS):
                    known = (asked.weights[level] > 0) & (found[level] >= 0)
                    counts = np.zeros(len(known), np.int64)
                    counts[known] = own.weights[level][found[level][known]]
                    asked.weights[level] = counts
                yield _row(row["origin"], asked.written(), kind=ANSWER, origin=number)
            yield _row(number, pickle.dumps(_small(cover), 5), kind=COVER, origin=number)

    schema = "range int, blob binary, kind int, origin int"
    return rows.mapInArrow(run, schema).select("range", "kind", "origin", "blob")


def scored(rows: DataFrame, share: int, top: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): candidates of each range that no longer one covers, the first
    ``top`` of each language in each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches):
            own, cover, pile = None, None, Pile(np.maximum)
            for row in group:
                if row["kind"] == OWN:
                    own = Automaton.read(row["blob"])
                elif row["kind"] == COVER:
                    cover = pickle.loads(row["blob"]).astype(np.int64)
                else:
                    pile.push(Automaton.read(row["blob"]))
            found = _best(own, cover, pile.whole(), share, top) if len(pile) else []
            if found:
                columns = [pa.array(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "a", "l", "r", "n", "score"])

    return rows.mapInArrow(run, "lang string, phrase string, a long, l long, r long, n long, score long")


def _best(own: Automaton, cover: np.ndarray, known: Automaton, share: int, top: int) -> list[tuple]:
    wanted, _, candidates = _wanted(own)
    place = known.locate(wanted)
    counts = [np.where(at >= 0, w[np.maximum(at, 0)] if len(w) else 0, 0) for at, w in zip(place, known.weights, strict=True)]
    words = own.words.to_pylist()
    by_lang: dict[str, list[tuple]] = {}
    for level, (arcs, lang_at, cuts) in zip((2, 3), candidates, strict=True):
        weight = own.weights[level][arcs]
        free = 100 * cover[arcs] < share * weight if level == 2 else np.ones(len(arcs), bool)
        path = np.stack(own.path(level, arcs), axis=1)[free].tolist()
        a, n = weight[free].tolist(), counts[0][lang_at][free].tolist()
        sides = [(counts[x][i][free].tolist(), counts[y][j][free].tolist()) for (x, i), (y, j) in cuts]
        for at, (lang, *phrase) in enumerate(path):
            # whole numbers of any size
            score, _, l, r = min(
                (1_000_000 * a[at] * a[at] // (left[at] * right[at]), k, left[at], right[at])
                for k, (left, right) in enumerate(sides)
            )
            row = (words[lang], " ".join(words[w] for w in phrase), a[at], l, r, n[at], score)
            by_lang.setdefault(row[0], []).append(row)
    out = []
    for rows in by_lang.values():
        out += sorted(rows, key=lambda row: (-row[6], -row[2], row[1].encode()))[:top]
    return out


def _dealt(rows: DataFrame, ranges: int) -> DataFrame:
    """One task for each range or few; of a range the counts come first."""
    order = [c for c in ("range", "kind", "origin") if c in rows.columns]
    return rows.repartition(ranges, "range").sortWithinPartitions(*order)


def collocations(
    docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of two and three words whose parts go together.

    Phrases occur ``least`` times, and no longer such phrase around them has ``share`` hundredths of their
    occurrences. The first ``top`` of each language by score, occurrences and byte order. Counts of shards and ranges,
    questions and answers are written to the shared folder."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    shared.small_blobs(spark)
    docs = docs.select("text", "lang")
    bounds = chosen_bounds(docs, range_bytes)
    n = len(bounds) + 1
    shards = sent_shards(docs, bounds)
    ranges = shared.stored(frequent_ranges(_dealt(shards, n), least), "collocation-ranges")
    own = ranges.select("range", F.lit(OWN).alias("kind"), F.col("range").alias("origin"), "blob")
    asked = _dealt(own.unionByName(requests(ranges, bounds)), n)
    known = shared.stored(answers(asked), "collocation-answers")
    found = shared.stored(scored(_dealt(own.unionByName(known), n), share, top), "collocation-scores")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_per_group(found, "lang", order, top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return best.select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "n", "score")
