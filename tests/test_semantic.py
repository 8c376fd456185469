"""Faithfulness and token similarity against plain loops."""

import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from glosswork.functions import text as T
from glosswork.operators import semantic as M

CASES = [
    (1, ["El decreto aprueba el gasto.", "La ley rige mañana"], [("a", "decreto aprueba gasto total"), ("b", "nothing of it")]),
    (2, ["word word other"], [("a", "WORD"), ("b", "wörd")]),
    (3, ["the of la"], [("a", "the of la")]),
    (4, ["no evidence"], []),
    (5, [], [("a", "x")]),
    (6, None, None),
    (None, ["null key"], [("a", "null key")]),
]
KINDS = "k int, claims array<string>, evidence array<struct<evidence_id: string, text: string>>"


def tokens(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return [w for w in re.findall(r"\w+", plain) if w not in T.FAITHFULNESS_STOPWORDS]


def recall(claim, evidence):
    words, held = tokens(claim), set(tokens(evidence))
    return sum(w in held for w in words) / len(words) if words else 0.0


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_faithfulness(spark, threshold):
    got = {r.k: r for r in M.faithfulness(spark.createDataFrame(CASES, KINDS), ["k"], "claims", "evidence", threshold=threshold).collect()}
    assert len(got) == len(CASES)
    for k, claims, evidence in CASES:
        r = got[k]
        if not claims or not evidence:
            assert (r.status, r.faithfulness, r.claims_supported) == ("NOT_CALCULABLE", None, 0)
            assert r.reason == ("no_traceable_rag_context" if not evidence else "no_claims")
            continue
        best = [max(recall(c, e) for _, e in evidence) for c in claims]
        assert r.faithfulness == sum(b >= threshold for b in best) / len(best)
        assert r.groundedness == pytest.approx(sum(best) / len(best))
        assert r.unsupported == [i for i, b in enumerate(best) if b < threshold]


def test_strategies_are_coerced(spark):
    df = spark.createDataFrame([(1, ["a"], [("x", "a")])], KINDS)

    @pandas_udf("string")
    def words(claim, evidence):
        return claim.map(lambda _: " entailed ")

    one = lambda s: M.faithfulness(df, ["k"], "claims", "evidence", s).first().groundedness
    assert one(lambda c, e: words(c["text"], e["text"])) == 1.0
    assert one(lambda c, e: c["text"] == e["text"]) == 1.0
    assert one(lambda c, e: F.lit(7)) == 1.0 and one(lambda c, e: F.lit(-1.5)) == 0.0
    assert one(lambda c, e: F.lit(float("nan"))) == 0.0 and one(lambda c, e: F.lit(float("inf"))) == 0.0
    assert one(lambda c, e: F.lit("0.25")) == 0.25 and one(lambda c, e: F.lit("maybe")) == 0.0 and one(lambda c, e: F.lit(None).cast("boolean")) == 0.0


def loop_score(c, r, weight):
    def words(t):
        return re.findall(r"\w+", unicodedata.normalize("NFKC", t).casefold())

    def cosine(x, y):
        a, b = M.hash_vectors([x])[0], M.hash_vectors([y])[0]
        return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))

    cs, rs = words(c), words(r)
    if not cs or not rs:
        return None, None, None
    p = [max(cosine(x, y) for y in rs) for x in cs]
    q = [max(cosine(x, y) for x in cs) for y in rs]
    mean = lambda v, ws: sum(a * weight(w) for a, w in zip(v, ws, strict=True)) / sum(map(weight, ws)) if sum(map(weight, ws)) else sum(v) / len(v)
    p, q = mean(p, cs), mean(q, rs)
    return p, q, 2 * p * q / (p + q) if p + q > 0 else 0.0


@pytest.mark.parametrize("idf, block", [(False, 2), (True, 1024)])
def test_bert_score(spark, idf, block):
    texts = [(1, "uno dos tres", "dos uno"), (2, "a b", "a b"), (3, "x", "y z"), (4, "", "y"), (5, None, "y"), (6, "dos dos dos tres", "dos tres tres Tres")]
    got = {r.k: r for r in M.bert_score(spark.createDataFrame(texts, "k int, c string, r string"), ["k"], "c", "r", idf=idf, block=block).collect()}
    held = [set(re.findall(r"\w+", r.casefold())) for _, _, r in texts]
    weight = (lambda w: math.log((len(texts) + 1) / (sum(w in h for h in held) + 1))) if idf else (lambda w: 1.0)
    for k, c, r in texts:
        want = loop_score(c or "", r, weight)
        assert [x if x is None else pytest.approx(x) for x in want] == [got[k].precision, got[k].recall, got[k].f1]
        assert got[k].status == ("CALCULATED" if want[2] is not None else "NOT_CALCULABLE")
