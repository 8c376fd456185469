"""Scores of extracted fields by per-field rules.

A case's gold and predicted fields are maps from a field's name to its values
(texts, as an array). What a field's values mean is a FieldSpec: how they are
normalised, which are valid, how near two of them are (a weight from 0 to 1) and
which other names the field goes by. All of it is column expressions on one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.text import let

# Statuses, and texts that stand for a status instead of a value.
STATUSES = ("CORRECT", "PARTIAL", "INCORRECT", "MISSING", "INVALID", "NOT_APPLICABLE", "NOT_CALCULABLE")
MARKERS = {
    "NOT_APPLICABLE": ("NOT_APPLICABLE", "NA", "N/A", "NO_APLICA", "NO APLICA", "NO_CORRESPONDE", "NO CORRESPONDE", "NOT APPLICABLE", "NO_APPLICABLE"),
    "NOT_CALCULABLE": ("NOT_CALCULABLE", "NOT CALCULABLE", "NO_CALCULABLE", "NO CALCULABLE", "UNAVAILABLE", "UNKNOWN"),
    "MISSING": ("MISSING", "AUSENTE", "FALTANTE", "MISSING_VALUE", "DATO_PENDIENTE", "DATO PENDIENTE"),
}


@dataclass(frozen=True)
class FieldSpec:
    """How one field is read and compared.

    normalise: from the array of values to the array that is compared, null if
    they can't be read. valid: of one value, before that. comparator: weight of a
    gold and a predicted value, 0 for no match; None for equality.
    """

    name: str
    normalise: Callable[[Column], Column] = lambda values: values
    valid: Callable[[Column], Column] | None = None
    comparator: Callable[[Column, Column], Column] | None = None
    aliases: Sequence[str] = field(default_factory=tuple)

    def of(self, fields: Column) -> tuple[Column, Column]:
        """(whether a name of the field is there, its values), the first name that is."""
        names = (self.name, *self.aliases)
        given, value = F.lit(False), F.lit(None).cast("array<string>")
        for name in reversed(names):
            has = F.map_contains_key(fields, F.lit(name))
            given, value = given | has, F.when(has, F.try_element_at(fields, F.lit(name))).otherwise(value)
        return F.coalesce(given, F.lit(False)), value


def _result(gold: Column, predicted: Column, tp: Column, weight: Column, alike: Column) -> Column:
    n, m = F.size(gold), F.size(predicted)
    p, r = F.try_divide(weight, m), F.try_divide(weight, n)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r))
    return F.struct(tp.alias("tp"), (m - tp).alias("fp"), (n - tp).alias("fn"), p.alias("precision"), r.alias("recall"), f1.alias("f1"), ((n == m) & (tp == n) & alike).alias("exact"))


def _same(gold: Column, predicted: Column) -> Column:
    """How many gold values have an equal prediction of their own."""
    times = lambda a, v: F.size(F.filter(a, lambda x: x == v))
    once = (F.size(F.array_distinct(gold)) == F.size(gold)) | (F.size(F.array_distinct(predicted)) == F.size(predicted))
    repeated = F.aggregate(F.array_intersect(gold, predicted), F.lit(0), lambda s, v: s + F.least(times(gold, v), times(predicted, v)))
    return F.when(once, F.size(F.array_intersect(gold, predicted))).otherwise(repeated)


def matched(gold: Column, predicted: Column, comparator: Callable[[Column, Column], Column] | None = None) -> Column:
    """struct(tp, fp, fn, precision, recall, f1, exact): each gold value in order takes the
    free prediction of the greatest weight, of equal ones the first.

    Precision and recall share the summed weights; a ratio without a base is
    null. exact: both have as many values, all are matched, and values at equal
    places have weight 1. Without a comparator equal values match, which needs no
    search.
    """
    if comparator is None:
        return let(_same(gold, predicted), lambda tp: _result(gold, predicted, tp, tp.cast("double"), gold == predicted))
    places = F.when(F.size(predicted) > 0, F.sequence(F.lit(0), F.size(predicted) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    start = F.struct(places.alias("free"), F.lit(0.0).alias("weight"))

    def step(state, value):
        # A struct's order is that of its fields: the greatest weight, then the least place.
        scored = F.transform(state["free"], lambda i: F.struct(F.coalesce(comparator(value, F.get(predicted, i)), F.lit(0.0)).alias("w"), (-i).alias("place")))

        def taken(best):
            took = F.struct(F.array_remove(state["free"], -best["place"]).alias("free"), (state["weight"] + best["w"]).alias("weight"))
            return F.when(best["w"] > 0, took).otherwise(state)

        return let(F.array_max(scored), taken)

    pairs = F.zip_with(gold, predicted, lambda g, p: comparator(g, p) == 1.0)
    alike = F.forall(pairs, lambda x: F.coalesce(x, F.lit(False)))
    return let(F.aggregate(gold, start, step), lambda end: _result(gold, predicted, F.size(predicted) - F.size(end["free"]), end["weight"], alike))


def _marker(values: Column) -> Column:
    """The status that a single value stands for, else null."""
    word = F.upper(F.trim(F.regexp_replace(F.get(values, F.lit(0)), r"\s+", " ")))
    out = F.lit(None).cast("string")
    for status, words in MARKERS.items():
        out = F.when((F.size(values) == 1) & word.isin(*words), status).otherwise(out)
    return out


def score_field(spec: FieldSpec, gold: Column, predicted: Column) -> Column:
    """struct(field, status, reason, accuracy, present, tp, fp, fn, precision, recall, f1, exact) of one field.

    Gold without a usable value is NOT_CALCULABLE, gold that says so or has an
    empty list NOT_APPLICABLE; both stay out of averages. A prediction that is
    absent is MISSING and one that can't be read INVALID, both with accuracy 0.
    """
    has_gold, g = spec.of(gold)
    has_guess, p = spec.of(predicted)

    def read(values):
        fine = F.lit(True) if spec.valid is None else F.forall(values, lambda v: F.coalesce(spec.valid(v), F.lit(False)))
        return F.when(fine & ~F.exists(values, lambda v: v.isNull()), spec.normalise(values))

    def judged(x):
        gm, pm, gn, pn = x["gm"], x["pm"], x["gn"], x["pn"]
        gone = F.coalesce(pm == "MISSING", F.lit(False)) | ~has_guess | x["p"].isNull() | (F.size(x["p"]) == 0)
        rules = [
            (gm == "NOT_APPLICABLE", "NOT_APPLICABLE", "explicitly_not_applicable"),
            (gm.isNotNull() | ~has_gold, "NOT_CALCULABLE", "gold_value_unavailable"),
            (F.size(x["g"]) == 0, "NOT_APPLICABLE", "empty_gold_set_is_not_applicable"),
            (gn.isNull(), "NOT_CALCULABLE", "invalid_gold_value"),
            (pm == "NOT_APPLICABLE", "INVALID", "prediction_declared_not_applicable"),
            (pm == "NOT_CALCULABLE", "NOT_CALCULABLE", "prediction_not_calculable"),
            (gone, "MISSING", "prediction_missing"),
            (pn.isNull(), "INVALID", "invalid_prediction"),
        ]
        status, reason = F.lit("SCORED"), F.lit(None).cast("string")
        for when, name, why in reversed(rules):
            when = F.coalesce(when, F.lit(False))
            status, reason = F.when(when, name).otherwise(status), F.when(when, why).otherwise(reason)
        empty = F.expr("cast(array() as array<string>)")
        return let(F.struct(status.alias("status"), reason.alias("reason"), F.coalesce(gn, empty).alias("g"), F.coalesce(pn, empty).alias("p")), lambda s: scored(s, pm))

    def scored(s, pm):
        def out(m):
            calculated = s["status"] == "SCORED"
            full = F.when(m["exact"], "CORRECT").when(m["f1"] > 0, "PARTIAL").otherwise("INCORRECT")
            status = F.when(calculated, full).otherwise(s["status"])
            zero = s["status"].isin("MISSING", "INVALID")
            present = has_guess & ~F.coalesce(pm.isin("MISSING", "NOT_CALCULABLE"), F.lit(False)) & (s["status"] != "MISSING")
            keep = lambda c: F.when(calculated, m[c]).alias(c)
            return F.struct(
                F.lit(spec.name).alias("field"), status.alias("status"), s["reason"].alias("reason"),
                F.when(calculated, m["f1"]).when(zero, 0.0).alias("accuracy"), present.alias("present"),
                *(keep(c) for c in ("tp", "fp", "fn", "precision", "recall", "f1", "exact")),
            )

        return let(F.when(s["status"] == "SCORED", matched(s["g"], s["p"], spec.comparator)), out)

    def parts(v):
        g, p = v["g"], v["p"]
        return let(F.struct(g.alias("g"), p.alias("p"), _marker(g).alias("gm"), _marker(p).alias("pm"), read(g).alias("gn"), read(p).alias("pn")), judged)

    return let(F.struct(g.alias("g"), p.alias("p")), parts)


def score_fields(cases: DataFrame, key: Sequence[str], gold: str, predicted: str, specs: Sequence[FieldSpec]) -> DataFrame:
    """key, status, coverage, presence_coverage, accuracy, conditional_accuracy, fields (one struct a spec) of every case.

    coverage: readable predictions of the calculable fields; accuracy: mean over
    these fields, conditional over the readable ones. Ratios without a base are null.
    """
    # Both maps are bound once: a plain name stands for its whole expression where the optimizer merges selections.
    both = F.struct(F.col(gold).alias("gold"), F.col(predicted).alias("predicted"))
    scored = let(both, lambda x: F.array(*(score_field(s, x["gold"], x["predicted"]) for s in specs)))
    rows = cases.select(*key, scored.alias("fields"))
    of = lambda *status: F.filter("fields", lambda x: x["status"].isin(*status))
    counted, valid = of("CORRECT", "PARTIAL", "INCORRECT", "MISSING", "INVALID"), of("CORRECT", "PARTIAL", "INCORRECT")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.coalesce(x["accuracy"], F.lit(0.0)))
    n, skipped = F.size(counted), F.size(of("NOT_CALCULABLE"))
    status = (
        F.when((n == 0) & (skipped == 0), "NOT_APPLICABLE").when(n == 0, "NOT_CALCULABLE").when(F.size(of("CORRECT")) == n, "CORRECT").otherwise("PARTIAL")
    )
    seen = F.size(F.filter(counted, lambda x: x["present"]))
    return rows.select(
        *key,
        status.alias("status"),
        F.try_divide(F.size(valid).cast("double"), n).alias("coverage"),
        F.try_divide(seen.cast("double"), n).alias("presence_coverage"),
        F.try_divide(total(counted), n).alias("accuracy"),
        F.try_divide(total(valid), F.size(valid)).alias("conditional_accuracy"),
        "fields",
    )
