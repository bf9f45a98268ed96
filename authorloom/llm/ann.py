"""Approximate nearest neighbours by inner product: a tree of k-means with best-bin-first search.

The tree is fitted on a bounded sample and indexes every vector by its leaf. A query goes
through the tree with a priority queue, the most promising node first, and gets the leaves in
the order in which they come out. How many of them are visited is calibrated: for a bounded
set of queries the true neighbours are found over all rows, and the visits are widened until
the wanted share of those is reached. Visits also go on until the leaves hold enough vectors
for a full answer.

Leaves are cut into blocks of vectors and visits into blocks of queries, so a leaf of any size
is spread over tasks. Each pair of blocks keeps its best ``k``, which are then ranked together.

Rules: vectors that are null, zero, of another length than most of the sample's, or that hold
null or non-finite components take no part. Ties go to the smaller id; scores are summed
component by component in double precision, so equal vectors tie exactly. A query is no
candidate of its own; repeated rows of an id count as one. Fewer than ``k`` candidates are all
returned. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authorloom.llm import shared

SAMPLE = 20_000
BRANCH = 8
LEAF_SAMPLE = 160
"""Sampled vectors under which a node is not split further."""
CALIBRATION = 200
RECALL = 0.96
BLOCK = 4096


@dataclass
class Tree:
    """Nodes in flat arrays: centre, spread, children; leaves are numbered from 0."""

    centre: np.ndarray
    spread: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray  # number of the leaf, or -1

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector: from the root to the nearest centre at each level."""
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            nearest = _nearest(vectors[rows], self.centre[kids])
            todo += [(kid, rows[nearest == i]) for i, kid in enumerate(kids)]
        return out

    def promise(self, query: np.ndarray) -> np.ndarray:
        """How large an inner product with ``query`` each node may well hold."""
        return self.centre @ query + 2 * self.spread * np.linalg.norm(query)

    def visits(self, query: np.ndarray, n_leaves: int, rows: int, sizes: np.ndarray) -> list[int]:
        """Leaves best first: ``n_leaves`` of them, and more until they hold ``rows`` vectors."""
        promise = self.promise(query)
        queue, out, held = [(-promise[0], 0)], [], 0
        while queue and (len(out) < n_leaves or held < rows):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
                held += int(sizes[self.leaf[node]])
            else:
                for kid in self.children[node]:
                    heapq.heappush(queue, (-promise[kid], kid))
        return out


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (vectors @ centres.T - 0.5 * np.square(centres).sum(axis=1)).argmax(axis=1)


def _kmeans(vectors: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = vectors[rng.choice(len(vectors), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(vectors, centres)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def fit(vectors: np.ndarray, branch: int = BRANCH, least: int = LEAF_SAMPLE, seed: int = 3) -> Tree:
    """Hierarchical k-means of a sample; equal vectors are not split."""
    rng = np.random.default_rng(seed)
    centre, spread, children, leaf = [], [], [], []
    n_leaves = 0

    def node(rows: np.ndarray) -> int:
        nonlocal n_leaves
        number = len(centre)
        mean = rows.mean(axis=0)
        centre.append(mean)
        spread.append(float(np.sqrt(np.square(rows - mean).mean())))
        children.append([])
        leaf.append(-1)
        parts = []
        if len(rows) > least:
            near = _nearest(rows, _kmeans(rows, branch, rng))
            parts = [rows[near == i] for i in range(branch) if (near == i).any()]
        if len(parts) < 2:
            leaf[number] = n_leaves
            n_leaves += 1
        else:
            children[number] = [node(part) for part in parts]
        return number

    node(vectors)
    return Tree(np.array(centre), np.array(spread), children, np.array(leaf))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, vector array<double>): finite, non-zero vectors of the usual length, one per id."""
    fine = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).where("id is not null and vector is not null and size(vector) > 0")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = fine.where(~bad & F.exists("vector", lambda x: x != 0))
    size = fine.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return fine.where(F.size("vector") == (size["size"] if size else 0)).groupBy("id").agg(
        F.min("vector").alias("vector")
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed in the order of the components."""
    out = np.zeros(len(queries))
    for q, v in zip(queries.T, vectors.T, strict=True):
        out += q * v
    return out


def _best(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best of ``vid`` for each of ``qid``; rounding of the fast product can't cost one."""
    rough = q @ v.T
    rough[qid[:, None] == vid[None, :]] = -np.inf
    near = min(k, rough.shape[1])
    edge = -np.partition(-rough, near - 1, axis=1)[:, near - 1 : near]
    slack = 1e-12 * (1 + np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1).max())
    row, col = np.nonzero((rough >= edge - slack) & (rough > -np.inf))
    found = pd.DataFrame({"query_id": qid[row], "vec_id": vid[col], "score": _exact(q[row], v[col])})
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return found.groupby("query_id", sort=False).head(k)


_PAIR = "query_id long, vec_id long, score double"


def _calibrate(tree: Tree, indexed: DataFrame, queries: DataFrame, k: int, sizes: np.ndarray) -> int:
    """Leaves to visit so that ``RECALL`` of the true neighbours of a bounded set of queries are seen."""
    chosen = shared.drawn(queries, "id", CALIBRATION).collect()
    if not chosen:
        return 1
    qid = np.array([r.id for r in chosen])
    q = np.array([r.vector for r in chosen], np.float64)
    shipped = indexed.sparkSession.sparkContext.broadcast((qid, q))  # CALIBRATION vectors at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q = shipped.value
        for batch in batches:
            for begin in range(0, len(batch), BLOCK):
                part = batch.iloc[begin : begin + BLOCK]
                vid = part["id"].to_numpy()
                best = _best(qid, q, vid, _matrix(part["vector"]), k)
                yield best.merge(part[["id", "leaf"]].rename(columns={"id": "vec_id"}), on="vec_id")

    found = indexed.select("id", "vector", "leaf").mapInPandas(run, f"{_PAIR}, leaf long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).toPandas()
    place = []
    for i, vector in zip(qid.tolist(), q, strict=True):
        order_of = {leaf: n for n, leaf in enumerate(tree.visits(vector, tree.n_leaves, 0, sizes))}
        place += [order_of[leaf] + 1 for leaf in true.loc[true["query_id"] == i, "leaf"]]
    if not place:
        return 1
    return int(np.sort(place)[min(len(place) - 1, int(np.ceil(RECALL * len(place))) - 1)])


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best found for every row where ``is_query``.

    ``is_query`` is an expression over ``id``."""
    spark = vectors.sparkSession
    rows = shared.stored(usable(vectors, id_col, vector_col), "ann-vectors")
    drawn = shared.drawn(rows, "id", sample).toPandas()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(drawn):
        return empty
    tree = fit(_matrix(drawn["vector"]))
    model = spark.sparkContext.broadcast(tree)  # fitted on the bounded sample

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=model.value.assign(_matrix(batch["vector"])))

    indexed = shared.stored(
        rows.mapInPandas(index, "id long, vector array<double>, leaf long"), "ann-index"
    )
    counts = indexed.groupBy("leaf").count().collect()  # one row per leaf of the tree
    sizes = np.zeros(tree.n_leaves, np.int64)
    for r in counts:
        sizes[r["leaf"]] = r["count"]
    queries = rows.where(is_query)
    n_leaves = _calibrate(tree, indexed, queries, k, sizes)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.iloc[begin : begin + 256]
                ways = [
                    model.value.visits(v, n_leaves, k + 1, sizes) for v in _matrix(part["vector"])
                ]
                part = part.assign(leaf=ways).explode("leaf")
                yield part.astype({"leaf": "int64"})

    visits = queries.mapInPandas(visit, "id long, vector array<double>, leaf long")
    v_blocks = spark.createDataFrame(
        [(i, max(1, -(-int(n) // BLOCK))) for i, n in enumerate(sizes)], "leaf long, v_blocks int"
    )
    q_counts = visits.groupBy("leaf").agg(F.ceil(F.count("*") / 1024).cast("int").alias("q_blocks"))
    grid = shared.stored(v_blocks.join(q_counts, "leaf"), "ann-grid")  # one row per leaf

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        return (
            df.join(F.broadcast(grid), "leaf")
            .withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
            .select("leaf", "q", "v", "id", "vector")
        )

    left, right = dealt(visits, "q", "v"), dealt(indexed, "v", "q")

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"}
            )
        parts = []
        for begin in range(0, len(q), 256):
            some = q.iloc[begin : begin + 256]
            parts.append(
                _best(some["id"].to_numpy(), _matrix(some["vector"]), v["id"].to_numpy(), _matrix(v["vector"]), k)
            )
        return pd.concat(parts)

    keys = ["leaf", "q", "v"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, _PAIR)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the rows of ``truth`` (query_id, vec_id) that ``found`` has."""
    n = truth.count()
    return found.join(truth, ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0
