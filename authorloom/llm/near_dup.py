"""Near-duplicate documents by b-bit MinHash, with every link confirmed on full shingle sets.

A text becomes the set of its distinct runs of five words. ``HASHES`` minima per set give
``BANDS`` band keys of ``ROWS`` minima each; of every minimum the low ``BITS`` bits are kept in
a packed signature. Sets that share a band are candidates:

1. equal sets are one class, and one document of each class takes part from here on;
2. every class is compared with the smallest one in any of its bands, which joins most groups;
3. in the bands that still hold several components, pairs of different components are
   compared by signature (share of equal low bits, corrected for chance agreement), in blocks
   that one task can hold; what estimates not clearly below the threshold connect is a cluster;
4. within each cluster the pairs of different components are confirmed on the full sets,
   computed anew from the texts, until they are joined or every pair has been tried.

Steps 3 and 4 go in two passes. In the first every row is in one block of its group and components
contract; only what then is still apart meets in all pairs of blocks, and rows of the largest component of a group
not with each other. A unit gives a row for each component that it joins, never for pairs. Rows dealt are
twice those of a group at most, unless several blocks of it are in none of the larger components.

At the threshold of 0.85 a pair shares no band with chance (1 - 0.85^4)^32, about 6e-11; at 0.8, 5e-8.

Rules: null and empty texts and texts without words have no shingles and link with nothing.
With fewer than five words the whole text is the one shingle. Repeated rows and equal texts
are links. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authorloom.llm import shared
from authorloom.llm.components import components

SHINGLE = 5
HASHES = 128
ROWS = 4
BANDS = HASHES // ROWS
BITS = 4
CHANCE = 1 / (1 << BITS)
"""Share of equal low bits of unequal minima."""
BLOCK = 2048
"""Texts that a task compares with as many others at a time."""
UNIT_BYTES = 8 << 20
"""Bytes of text of such a block, on average."""

_LOWER = shared.lower_ascii()
_WORD = np.ones(256, bool)
_WORD[9:14] = _WORD[32] = False
_rng = np.random.default_rng(20240817)
_MULTIPLY = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data, offsets = shared.utf8(texts)
    data = _LOWER[data]
    starts, ends, bounds = shared.words(data, offsets, _WORD)
    word = shared.RollingHash(data, shared.WORD_BASE).of(starts, ends)
    runs = np.zeros(max(len(word) - SHINGLE + 1, 0), np.uint64)
    for i, place in enumerate(_PLACE):
        runs += word[i : i + len(runs)] * place
    runs = shared.mix(runs)
    out = []
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        if end - begin >= SHINGLE:
            out.append(np.unique(runs[begin : end - SHINGLE + 1]))
        elif end > begin:
            h = np.uint64(end - begin) + (word[begin:end] * _PLACE[: end - begin]).sum(dtype=np.uint64)
            out.append(shared.mix(np.array([h])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minima(values: np.ndarray) -> np.ndarray:
    """``HASHES`` minima of a non-empty set."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(short), 512):
        part = short[None, begin : begin + 512] * _MULTIPLY[:, None]
        part += _ADD[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def pack(low: np.ndarray) -> np.ndarray:
    """Low ``BITS`` bits of the minima, two minima to a byte."""
    nibbles = (low & np.uint32(15)).astype(np.uint8)
    return nibbles[..., ::2] | (nibbles[..., 1::2] << 4)


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the number of the band is part of it."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        h = shared.mix(h * np.uint64(shared.GRAM_BASE) + row)
    return h.view(np.int64)


_EQUAL = np.array([(b & 15 == 0) + (b >> 4 == 0) for b in range(256)], np.uint8)


def slack(percent: int) -> float:
    """Five standard errors of the estimate at the threshold, 0.16 at 0.85 and 0.18 at 0.8."""
    equal = percent / 100 * (1 - CHANCE) + CHANCE
    return 5 * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - CHANCE)


def estimate(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarities of one packed signature with many (rows of bytes)."""
    same = _EQUAL[others ^ one].sum(axis=1, dtype=np.int32)
    return (same / HASHES - CHANCE) / (1 - CHANCE)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature, bands); the last three null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for block in shared.blocks(batches):
            sizes, keys, signatures, bands = [], [], [], []
            for values in shingles(block.column("text")):
                sizes.append(len(values))
                if not len(values):
                    keys.append(None), signatures.append(None), bands.append(None)
                    continue
                low = minima(values)
                keys.append(xxhash.xxh3_128_digest(values.tobytes()))
                signatures.append(pack(low).tobytes())
                bands.append(band_keys(low))
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(signatures, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_key", "signature", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_shingles long, set_key binary, signature binary, bands array<long>"
    )


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose full sets have 100 · intersection >= percent · union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in shared.blocks(batches, "text_b"):
            for part in shared.blocks([block], "text_a"):
                left, right = shingles(part.column("text_a")), shingles(part.column("text_b"))
                common = np.array(
                    [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)]
                )
                union = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)]) - common
                yield part.select(["a", "b"]).filter(pa.array(100 * common >= percent * union))

    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"
    )
    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def dealt_once(members: DataFrame, key: str) -> DataFrame:
    """Every row of each ``key`` in one block of about a weight of 1, at random; sorted by (key, i, j)."""
    blocks = members.groupBy(key).agg(F.ceil(F.sum("weight")).cast("int").alias("n_blocks"))
    dealt = members.join(blocks, key).withColumn("i", F.pmod(F.xxhash64(key, "doc_id"), F.col("n_blocks")).cast("int"))
    return dealt.withColumn("j", F.col("i")).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def dealt_all(members: DataFrame, key: str) -> DataFrame:
    """Rows of each ``key`` in units such that any two rows of different components meet in one.

    Rows of the heaviest component never have to meet each other: they and the rest are cut into
    blocks apart, and a unit is a block of the rest with any other block. So where the rest fills one
    block, which is the rule after the first pass, a row of the heaviest component is dealt once."""
    by_component = members.groupBy(key, "component").agg(F.sum("weight").alias("w"))
    sizes = by_component.groupBy(key).agg(
        F.max(F.struct("w", "component")).alias("top"), F.sum("w").alias("all"), F.count("*").alias("n")
    )
    sizes = sizes.where("n > 1").select(
        key,
        F.col("top.component").alias("top"),
        F.greatest(F.ceil("top.w"), F.lit(1)).cast("int").alias("many"),
        F.greatest(F.ceil(F.col("all") - F.col("top.w")), F.lit(1)).cast("int").alias("few"),
    )
    place, heavy = F.xxhash64(key, "doc_id"), F.col("component") == F.col("top")
    every = F.col("many") + F.col("few") - 1
    dealt = (
        members.join(sizes, key)
        .withColumn(
            "block",
            F.when(heavy, F.pmod(place, F.col("many"))).otherwise(F.col("many") + F.pmod(place, F.col("few"))).cast("int"),
        )
        .withColumn("other", F.explode(F.sequence(F.when(heavy, F.col("many")).otherwise(0), every)))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .drop("block", "other", "many", "few", "top")
    )
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def joined_components(units: DataFrame, key: str, find: Callable[[pa.Table, np.ndarray], tuple[list, list]]) -> DataFrame:
    """(a, b): components that ``find`` joins within a unit, each with the smallest of its group.

    ``find`` gets a unit and its components and gives pairs of rows. A unit gives fewer rows than it has components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(shared.blocks(batches) if "text" in names else batches, key):
            own = unit.column("component").to_numpy()
            a, b = smallest_of_group(own, *find(unit, own))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    names = units.columns
    return units.mapInArrow(run, "a long, b long")


def smallest_of_group(component: np.ndarray, a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(component, smallest component that it is joined with) for those that some pairs of rows join."""
    known, place = np.unique(component, return_inverse=True)
    least = np.arange(len(known))
    for x, y in zip(place[a].tolist(), place[b].tolist(), strict=True):
        while least[x] != x:
            least[x] = x = least[least[x]]
        while least[y] != y:
            least[y] = y = least[least[y]]
        least[max(x, y)] = min(x, y)
    while (least[least] != least).any():
        least = least[least]
    moved = least != np.arange(len(known))
    return known[moved], known[least[moved]]


def likely_clusters(members: DataFrame, least: float) -> DataFrame:
    """(component, cluster): components that estimates of ``least`` or more connect, over all bands.

    ``members`` has (key, doc_id, component, signature). In a first pass every row of a band is in one
    block, and each component takes the smallest one that it looks like in any band; that joins groups
    of copies. In the bands that still hold several clusters all pairs of different clusters are compared.
    """

    def alike(unit: pa.Table, component: np.ndarray) -> tuple[list[int], list[int]]:
        signature = np.frombuffer(b"".join(unit.column("signature").to_pylist()), np.uint8)
        return _spanning(signature.reshape(len(component), -1), component, least)

    members = members.withColumn("weight", F.lit(1 / BLOCK))
    near = joined_components(dealt_once(members, "key"), "key", alike).groupBy("a").agg(F.min("b").alias("b"))
    first = components(near)
    second = components(joined_components(dealt_all(relabelled(members, first), "key"), "key", alike).distinct())
    return both_maps(first, second)


def relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``component`` replaced where ``labels`` (node, component) has another."""
    new = labels.select(F.col("node").alias("component"), F.col("component").alias("new_component"))
    rows = rows.join(new, "component", "left")
    return rows.withColumn("component", F.coalesce("new_component", "component")).drop("new_component")


def both_maps(first: DataFrame, second: DataFrame) -> DataFrame:
    """(component, cluster): ``first``, then ``second``, as one table; nodes in neither do not occur."""
    through = relabelled(first, second).select("node", "component")
    only = second.join(first.select("node"), "node", "left_anti").select("node", "component")
    return through.unionByName(only).select(F.col("node").alias("component"), F.col("component").alias("cluster"))


def _spanning(signature: np.ndarray, component: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """Tree edges of a walk over the pairs of different components that look alike."""
    rest = np.arange(len(signature))
    a: list[int] = []
    b: list[int] = []
    while len(rest):
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            at = stack.pop()
            near = (estimate(signature[at], signature[rest]) >= least) & (component[rest] != component[at])
            found = rest[near].tolist()
            rest = rest[~near]
            a += [at] * len(found)
            b += found
            stack += found
    return a, b


def confirmed_joins(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(component, cluster): components that confirmed links join within each ``cluster`` of likeness.

    ``members`` has (cluster, doc_id, component). A unit reads its texts, takes the pairs of
    different components that the estimate does not exclude, the most promising texts first,
    and confirms them on full sets until they are joined or all tried. The first pass has every text in
    one block; clusters of several blocks that still hold several components are then tried in all pairs."""
    weight = F.greatest(F.lit(1 / BLOCK), F.octet_length("text") / F.lit(float(UNIT_BYTES)))
    filled = members.join(texts.select("doc_id", "text"), "doc_id").withColumn("weight", weight)
    filled = shared.stored(filled, "near-dup-clusters")
    least = percent / 100 - slack(percent)

    def confirmed(unit: pa.Table, component: np.ndarray) -> tuple[list[int], list[int]]:
        sets = [v for part in unit.to_batches(512) for v in shingles(part.column("text"))]
        return _joined(sets, component, least, percent)

    first = components(joined_components(dealt_once(filled, "cluster"), "cluster", confirmed).distinct())
    large = filled.groupBy("cluster").agg(F.sum("weight").alias("w")).where("w > 1").select("cluster")
    again = relabelled(filled.join(large, "cluster", "left_semi"), first)
    second = components(joined_components(dealt_all(again, "cluster"), "cluster", confirmed).distinct())
    out = shared.stored(both_maps(first, second), "near-dup-joins")
    shared.drop(filled)
    return out


def _joined(
    sets: list[np.ndarray], component: np.ndarray, least: float, percent: int
) -> tuple[list[int], list[int]]:
    """Confirmed pairs of sets that join different components, until no pair is left to try."""
    signature = np.stack([pack(minima(values)) for values in sets])
    label = np.unique(component, return_inverse=True)[1]
    high = [int((estimate(one, signature) >= percent / 100).sum()) for one in signature]
    a: list[int] = []
    b: list[int] = []
    for at in np.argsort(high, kind="stable")[::-1].tolist():
        apart = np.flatnonzero(label != label[at])
        likeness = estimate(signature[at], signature[apart])
        near = np.flatnonzero(likeness >= least)
        for other in apart[near[np.argsort(-likeness[near], kind="stable")]].tolist():
            if label[other] == label[at]:
                continue
            x, y = sets[at], sets[other]
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                a.append(at), b.append(other)
                label[label == label[other]] = label[at]
    return a, b


def _units(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of equal (key, i, j), which come one after the other, as one table each."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (key, "i", "j")])
        cuts = (np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist()
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            unit = tuple(ids[:, start].tolist())
            if rest and unit != last:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(start, stop - start))
            last = unit
    if rest:
        yield pa.Table.from_batches(rest)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    ``component_id`` is the smallest doc_id that can be reached over links, itself included.
    Some stages are written to the shared folder while the plan is built. Rows without doc_id
    are kept and link with nothing.
    """
    shared.small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sketch = shared.stored(sketches(docs), "near-dup-sketch")
    filled = sketch.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = filled.groupBy("set_key").agg(F.min("doc_id").alias("class_id"))
    firsts = classes.select(F.col("class_id").alias("doc_id"))
    keyed = filled.select("doc_id", F.explode("bands").alias("key")).join(firsts, "doc_id", "left_semi")
    keyed = keyed.distinct()
    shared_keys = (
        keyed.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    )
    members = shared.stored(keyed.join(shared_keys.select("key", "pivot"), "key"), "near-dup-bands")
    wanted = members.select("doc_id").distinct()
    some = shared.maybe_among(docs, wanted, "doc_id").where("_maybe").drop("_maybe")
    texts = some.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    texts = shared.stored(texts, "near-dup-texts")

    stars = members.groupBy(F.col("doc_id").alias("b")).agg(F.min("pivot").alias("a")).where("a < b")
    links = shared.stored(confirm(stars.select("a", "b"), texts, percent), "near-dup-stars")
    first_labels = components(links)
    shared.drop(links)

    labelled = members.join(first_labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    labelled = labelled.select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    still_open = labelled.join(open_keys.where("lo < hi").select("key"), "key", "left_semi")
    signatures = filled.select("doc_id", "signature").dropDuplicates(["doc_id"])
    still_open = shared.stored(still_open.join(signatures, "doc_id"), "near-dup-open")
    shared.drop(members)
    sets = shared.stored(sketch.select("doc_id", "n_shingles", "set_key"), "near-dup-sets")
    likely = shared.stored(likely_clusters(still_open, percent / 100 - slack(percent)), "near-dup-likely")
    clustered = still_open.select("doc_id", "component").distinct().join(likely, "component")
    joins = confirmed_joins(clustered, texts, percent)
    for done in (texts, still_open, sketch):
        shared.drop(done)
    labels = both_maps(first_labels, joins.select(F.col("component").alias("node"), F.col("cluster").alias("component")))
    labels = labels.select(F.col("component").alias("class_id"), F.col("cluster").alias("component"))
    classes = sets.where("set_key is not null and doc_id is not null")
    classes = classes.groupBy("set_key").agg(F.min("doc_id").alias("class_id"))

    return (
        sets.join(classes, "set_key", "left")
        .join(labels, "class_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "class_id", "doc_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_first(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all columns, of one document per group: that with the smallest id.

    Of repeated rows with the same id one stays; rows without an id all stay."""
    found = near_duplicates(docs, percent).where("doc_id is not null").groupBy("doc_id")
    found = found.agg(F.count("*").alias("_n"), F.max("kept").alias("_kept"))
    # most rows are neither copies nor repeated; they pass without a join
    other = shared.stored(found.where("_n > 1 or not _kept"), "near-dup-other")
    marked = shared.maybe_among(docs, other, "doc_id")
    plain = marked.where("not _maybe or doc_id is null").drop("_maybe")
    looked_at = marked.where("_maybe and doc_id is not null").drop("_maybe").join(other, "doc_id", "left")
    once = looked_at.where("_n is null").select(*docs.columns)
    repeated = looked_at.where("_kept").select(*docs.columns).dropDuplicates(["doc_id"])
    return plain.select(*docs.columns).unionByName(once).unionByName(repeated)
