"""Containment and token overlap against all pairs."""

import random

import pytest

from glosswork.operators import overlap

ODD = [None, "", "  ", "A", "a b", " lead and trail ", "É x É", "x" * 50_000, "a " * 20_000, "line\none\ttwo", "A\nB", "word"]


def tables(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["the"] * 30
    docs = [" ".join(rng.choice(words) for _ in range(rng.randrange(80))) for _ in range(80)]
    items = ODD + [" ".join(docs[rng.randrange(80)].split()[3 : 3 + rng.randrange(12)]) for _ in range(30)] + [d[2:30].upper() for d in docs[:10]]
    docs = list(enumerate(docs + ODD))
    items = list(enumerate(items))
    return docs, items, spark.createDataFrame(docs, "k int, t string"), spark.createDataFrame(items, "j int, p string")


def test_contained(spark):
    docs, items, d, i = tables(spark, 1)
    got = sorted((r.k, r.j) for r in overlap.contained(d, i, "k", "t", "j", "p").collect())
    assert got == sorted((k, j) for k, t in docs for j, p in items if (p or "").lower() in (t or "").lower())


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.5, 2 / 3, 0.9, 1.0])
def test_overlapping(spark, threshold):
    docs, items, d, i = tables(spark, 2)
    want = []
    for k, t in docs:
        own = set((t or "").lower().split())
        for j, p in items:
            asked = set((p or "").lower().split())
            if asked and len(own & asked) / len(asked) >= threshold:
                want.append((k, j, len(own & asked) / len(asked)))
    assert sorted(map(tuple, overlap.overlapping(d, i, "k", "t", "j", "p", threshold).collect())) == sorted(want)


def test_plan_has_no_nested_loop(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    for df in (overlap.overlapping(docs, items, "doc_id", "text", "item_id", "text", 0.5), overlap.contained(docs, items, "doc_id", "text", "item_id", "text")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        overlap.overlapping(docs, items, "doc_id", "text", "item_id", "text", 0)
