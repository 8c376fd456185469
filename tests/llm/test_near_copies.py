"""The pipeline's near-duplicate stage on planted copies and against all pairs."""

import random

import corpus_pipeline
import pytest
from brute import groups, similarity

from glosswork.llm import near_copies, simhash


@pytest.fixture(scope="module")
def planted():
    """Texts with copies of similarity 0.8 to 0.95, chains of them, copies below 0.8, and a line that all hold."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, near, apart = [], [], []
    for k in range(40):
        base = rng.choices(vocabulary, k=200) + "this very common line stands in every text".split()
        rows.append((len(rows), " ".join(base)))
        first = len(rows) - 1
        for edits in (1, 2, 3, 4, 7):
            words = list(base)
            for at in range(edits):
                words[10 + at * 190 // edits] = f"new{k}x{edits}x{at}"
            rows.append((len(rows), " ".join(words)))
            s = similarity(rows[first][1], rows[-1][1])
            (near if s >= 0.8 else apart).append((first, len(rows) - 1, s))
    assert min(s for *_, s in near) < 0.86 and max(s for *_, s in near) > 0.9 and apart
    return rows, near


def test_near_stage_on_planted_copies(spark, planted):
    rows, near = planted
    got = {r.doc_id for r in corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), None).collect()}
    assert not got & {b for _, b, _ in near}
    assert got == {rows[min(g)][0] for g in groups(rows)}


def test_near_stage_on_a_table_and_without_ids(spark, sf_dir, planted):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, None).collect()}
    assert got == {min(rows[i][0] for i in g) for g in groups(rows)}
    (one, two), other = (planted[0][i][1] for i in (0, 1)), planted[0][6][1]
    bare = spark.createDataFrame([(None, one), (None, two), (5, other), (None, other + " end"), (7, None), (8, "")], "doc_id long, text string")
    kept = corpus_pipeline.near_stage(spark, bare, None).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 5, 7]
    assert corpus_pipeline.near_stage(spark, bare.where("doc_id < 0"), None).count() == 0


def test_near_stage_goes_through_simhash(spark, planted, monkeypatch):
    """Every text passes the fingerprints' grid; the pairs are those that comparing all fingerprints gives."""
    rows, near = planted
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, near = [], {(a, b) for a, b, _ in near}
    whole = simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda d, *a: seen.append((d.count(), *a)) or whole(d, *a))
    kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, None).collect()}
    assert seen == [(len(rows),)] and kept == {rows[min(g)][0] for g in groups(rows)}

    fps = [simhash.fingerprint(t) for _, t in rows]
    meet = [[k for k, y in enumerate(fps) if (x ^ y).bit_count() <= simhash.DISTANCE] for x in fps]
    least, before = list(range(len(rows))), None
    while least != before:  # least row number reachable
        before, least = least, [min(least[k] for k in ks) for ks in meet]
    pairs = near_copies.fingerprint_pairs(docs.withColumnRenamed("doc_id", "node"))
    got = {(r.a, r.b) for r in pairs.collect()}
    assert got == {(low, i) for i, low in enumerate(least) if low != i}
    assert got & near
