"""Search over the whole stated query set, in blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.operators import retrieval as V
from glosswork.plans import QUERIES


def test_rag_retrieval_asks_every_twentieth_vector(spark, sf_dir):
    ids = {r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = {r.query_id for r in QUERIES["e14_rag_retrieval"](spark, sf_dir).collect()}
    assert got == {i for i in ids if i % 20 == 0} and len(got) > 10


def test_top_k_in_many_blocks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "CHUNK_BLOCK", 60)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    ids = sorted(rows)
    m = np.array([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    asked = table.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding")
    got = {}
    for r in V.top_k(asked, table, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in (i for i in ids if i % 20 == 0):
        score = np.round(m @ m[ids.index(q)], 12)
        assert got.pop(q) == [i for s, i in sorted((-s, i) for s, i in zip(score, ids) if i != q)][:5]
    assert not got


def test_order_of_negative_scores_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [-1.0, 0.1]), (2, [-1.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, None), (6, [float("nan"), 1.0]), (7, [2.0, 0.0]), (8, [3.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = table.where("vec_id = 0").selectExpr("vec_id as query_id", "embedding")
    got = V.top_k(asked, table, 10).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [7, 8, 2, 1] and [r.score for r in got][2:] == [0.0, 0.0]
    turned = V.top_k(asked, table, 10, ties=[-F.col("vec_id")]).orderBy("rank").collect()
    assert [r.vec_id for r in turned] == [8, 7, 2, 1]
    assert V.top_k(asked, table, 10, minimum=0.5).count() == 2
    for k in (0, 51):
        with pytest.raises(ValueError):
            V.top_k(asked, table, k)


def test_budget_of_groups_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(V, "ROUND", 16)
    rng = random.Random(4)
    rows = [(rng.choice("aab"), i, rng.choice([0, 3, 40, 400, 5000]), rng.randint(1, 60)) for i in range(1500)] + [("c", 9000, 10_000, 1)]
    got = {}
    for r in V.budget_fold(spark.createDataFrame(rows, "g string, i long, bytes long, tokens long"), "g", "i", 6000, 3000).collect():
        got.setdefault(r.g, set()).add(r.i)
    for g in "ab":
        b, t, want = 6000, 3000, set()
        for name, i, size, tokens in rows:
            if name == g and size + 2 <= b and tokens <= t:
                b, t = b - size - 2, t - tokens
                want.add(i)
        assert got[g] == want
    assert "c" not in got
