import numpy as np
from odd_tables import SMALL  # noqa: F401
from pyspark.sql import functions as F

from authorloom.llm import ann


def brute(rows, k, step):
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for q in ids[ids % step == 0]:
        score = np.zeros(len(ids))
        for a, b in zip(vectors[ids == q][0], vectors.T):
            score += a * b
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_exact_scores(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    truth = brute([(r.vec_id, r.embedding) for r in table.collect()], 20, 20)
    got = found(ann.nearest(table, F.col("id") % 20 == 0))
    assert got.keys() == truth.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len(set(got[q]) & set(truth[q])) for q in truth)
    assert hits >= 0.9 * 20 * len(truth)


def test_tree_leaves_and_hot_vector(spark, monkeypatch):
    """Many leaves, a third of the rows one vector, blocks far smaller than that group."""
    monkeypatch.setattr(ann, "LEAF_SAMPLE", 20)
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=8)).tolist()) for i in range(600)]
    rows += [(1000 + i, [1.0] * 8) for i in range(300)]
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, k=5))
    truth = brute(rows, 5, 50)
    hits = sum(len(set(got[q]) & set(truth[q])) for q in truth)
    assert hits >= 0.9 * sum(map(len, truth.values()))


def test_few_candidates_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0])]
    rows += [(5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0]), (9, []), (None, [1.0, 1.0])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, leaf int, id int")
    got = found(ann.nearest(table, F.col("id") % 2 == 0))
    assert got == {0: [(1, 0.5), (2, 0.5)], 2: [(0, 0.5), (1, 0.5)]}
    assert ann.nearest(table.where("false"), F.lit(True)).count() == 0
    assert ann.nearest(table.where("vec_id = 0"), F.lit(True)).count() == 0
