"""Field scores against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from glosswork.operators import fields as X


def loop(gold, predicted, weigh):
    free, tp, total = list(predicted), 0, 0.0
    for g in gold:
        best, at = 0.0, None
        for i, p in enumerate(free):
            if weigh(g, p) > best:
                best, at = weigh(g, p), i
        if at is not None:
            tp, total = tp + 1, total + best
            free.pop(at)
    n, m = len(gold), len(predicted)
    p, r = (total / m if m else None), (total / n if n else None)
    f1 = 2 * p * r / (p + r) if p is not None and r is not None and p + r else None
    exact = n == m == tp and all(weigh(g, q) == 1 for g, q in zip(gold, predicted, strict=True))
    return tp, m - tp, n - tp, p, r, f1, exact


def near(g, p):
    return 1.0 if g == p else 0.5 if g[0] == p[0] else 0.25 if g[1:] == p[1:] and len(g) > 1 else 0.0


def near_column(g, p):
    return F.when(g == p, 1.0).when(F.substring(g, 1, 1) == F.substring(p, 1, 1), 0.5).when((F.substring(g, 2, 9) == F.substring(p, 2, 9)) & (F.length(g) > 1), 0.25).otherwise(0.0)


def test_matched_equals_loop(spark):
    rng = random.Random(6)
    some = lambda: ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(6))]
    rows = [(i, some(), some()) for i in range(400)] + [(900, ["a", "ab"], ["a", "ab"]), (901, ["a", "ab"], ["ab", "a"]), (902, [], []), (903, ["a"], []), (904, [], ["a"])]
    df = spark.createDataFrame(rows, "i int, g array<string>, p array<string>")
    for column, plain in ((near_column, near), (lambda g, p: (g == p).cast("double"), lambda g, p: float(g == p)), (None, lambda g, p: float(g == p))):
        got = {r.i: tuple(r.m) for r in df.select("i", X.matched(F.col("g"), F.col("p"), column).alias("m")).collect()}
        for i, g, p in rows:
            want = loop(g, p, plain)
            assert [x if x is None else pytest.approx(x) for x in want] == list(got[i]), (g, p)


SPECS = [
    X.FieldSpec("norma", normalise=lambda vs: F.transform(vs, lambda v: F.lower(F.trim(v))), aliases=("normas", "legal_basis")),
    X.FieldSpec("plazo", valid=lambda v: v.rlike("^[0-9]+$"), comparator=lambda g, p: F.greatest(F.lit(0.0), 1 - F.abs(g.cast("double") - p.cast("double")) / 10)),
]


def case(spark, gold, predicted):
    df = spark.createDataFrame([(1, gold, predicted)], "i int, gold map<string,array<string>>, predicted map<string,array<string>>")
    return X.score_fields(df, ["i"], "gold", "predicted", SPECS).first()


@pytest.mark.parametrize("gold, predicted, status, reason, accuracy", [
    (["Ley 1"], ["ley 1 "], "CORRECT", None, 1.0),
    (["Ley 1", "Ley 2"], ["ley 2"], "PARTIAL", None, 2 / 3),
    (["Ley 1"], ["ley 9"], "INCORRECT", None, None),
    (["n/a"], ["ley 9"], "NOT_APPLICABLE", "explicitly_not_applicable", None),
    (["no  corresponde"], ["x"], "NOT_APPLICABLE", "explicitly_not_applicable", None),
    (["unknown"], ["x"], "NOT_CALCULABLE", "gold_value_unavailable", None),
    ([], ["x"], "NOT_APPLICABLE", "empty_gold_set_is_not_applicable", None),
    ([None], ["x"], "NOT_CALCULABLE", "invalid_gold_value", None),
    (["Ley 1"], ["NO APLICA"], "INVALID", "prediction_declared_not_applicable", 0.0),
    (["Ley 1"], ["unavailable"], "NOT_CALCULABLE", "prediction_not_calculable", None),
    (["Ley 1"], ["dato pendiente"], "MISSING", "prediction_missing", 0.0),
    (["Ley 1"], [], "MISSING", "prediction_missing", 0.0),
    (["Ley 1"], None, "MISSING", "prediction_missing", 0.0),
    (["Ley 1"], [None], "INVALID", "invalid_prediction", 0.0),
])
def test_statuses(spark, gold, predicted, status, reason, accuracy):
    r = case(spark, {"norma": gold}, {"legal_basis": predicted})
    f = r.fields[0]
    assert (f.status, f.reason) == (status, reason)
    assert f.accuracy is None if accuracy is None else f.accuracy == pytest.approx(accuracy)
    assert (r.fields[1].status, r.fields[1].reason) == ("NOT_CALCULABLE", "gold_value_unavailable")


def test_case_totals(spark):
    r = case(spark, {"norma": ["Ley 1"], "plazo": ["30"]}, {"normas": ["ley 1"], "plazo": ["25"]})
    assert (r.status, r.coverage, r.presence_coverage) == ("PARTIAL", 1.0, 1.0)
    assert r.fields[1].status == "PARTIAL" and r.fields[1].f1 == pytest.approx(0.5) and r.accuracy == pytest.approx(0.75)
    r = case(spark, {"norma": ["Ley 1"], "plazo": ["30"]}, {"plazo": ["soon"]})
    assert (r.coverage, r.presence_coverage, r.accuracy, r.conditional_accuracy) == (0.0, 0.5, 0.0, None)
    assert [f.status for f in r.fields] == ["MISSING", "INVALID"]
    assert case(spark, {}, {}).status == "NOT_CALCULABLE"
    assert case(spark, {"norma": ["NA"], "plazo": ["NA"]}, {}).status == "NOT_APPLICABLE"
    assert case(spark, None, None).status == "NOT_CALCULABLE"
