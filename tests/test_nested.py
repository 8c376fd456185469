"""Functions without SQL against plain loops."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from glosswork.functions import nested as N
from glosswork.functions import text as T
from glosswork.operators import reconcile as Q


def chrf(c, r, order=6, beta=2.0):
    c, r = "".join(c.split()), "".join(r.split())
    top = min(order, len(c), len(r))
    if not top:
        return 1.0 if c == r else 0.0
    p = q = 0.0
    for n in range(1, top + 1):
        a, b = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (c, r))
        hit = sum((a & b).values())
        p, q = p + hit / sum(a.values()) / top, q + hit / sum(b.values()) / top
    return (1 + beta**2) * p * q / (beta**2 * p + q) if p + q else 0.0


def test_chrf(spark):
    rng = random.Random(2)
    texts = ["", " ", "a", "ab", "\U0001f600 x", "aaaa aaaa"] + ["".join(rng.choice("abñ \U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    rows = [(rng.choice(texts), rng.choice(texts)) for _ in range(400)] + [("", ""), (None, "x"), ("x", None)]
    got = spark.createDataFrame(rows, "c string, r string").select("c", "r", T.chrf()(F.col("c"), F.col("r")).alias("s")).collect()
    assert len(got) == len(rows)
    for x in got:
        if x.c is None or x.r is None:
            assert x.s is None
        else:
            assert abs(x.s - chrf(x.c, x.r)) < 1e-9, x


def test_nested_json(spark):
    deep = {"a": {"Cost": 1}, "b": [{"sources": ["no"], "t": "x"}, "y"], "cost_usd": {"amount": 2}}
    nest = json.dumps(deep)
    for _ in range(300):
        nest = f"[{nest}]"
    rows = [(1, json.dumps(deep)), (2, nest), (3, "{bad"), (4, None), (5, '"plain"')]
    df = spark.createDataFrame(rows, "i int, j string")
    got = {r.i: (r.v, r.t) for r in df.select("i", N.first_value(N.COST_KEYS)(F.col("j")).alias("v"), N.flat_text()(F.col("j")).alias("t")).collect()}
    assert got[1] == ('{"amount": 2}', "x y") and got[2] == got[1]
    assert got[3] == got[4] == (None, None) and got[5] == (None, "plain")


def test_fallback_match_keeps_repeated_rows(spark):
    items = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2), (None, 3)], "k string, n int")
    catalog = spark.createDataFrame([("x", "one"), ("y-base", "two"), ("y-base", "too")], "c string, v string")
    got = sorted((r.k or "", r.n, r.matched) for r in Q.fallback_match(items, catalog, [F.col("k"), F.concat("k", F.lit("-base"))], "c", "v").collect())
    assert got == [("", 3, None), ("x", 1, "one"), ("x", 1, "one"), ("y", 2, "too")]
