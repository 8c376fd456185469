"""The legal gate and factual fidelity of drafts against gold facts.

cases: one row a case with its prompt and the draft's text; facts: the gold facts
of the cases, one row each (case, field, index, value, and critical where it
matters). Facts meet their case by its key and are summed again, so a case may
have any number of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import decrees as D
from glosswork.functions import text as T
from glosswork.operators import evaluation as E


def _met(cases: DataFrame, facts: DataFrame, case: str, prompt: str, draft: str, noise: Sequence[str]) -> DataFrame:
    """Facts with their case's texts and whether the prompt discloses them; facts that are noise are left out."""
    own = cases.select(F.col(case).alias("_c"), F.col(prompt).alias("_prompt"), F.col(draft).alias("_draft"))
    met = facts.join(own, F.col(case) == F.col("_c"))
    return met.withColumn("disclosed", E.disclosed(F.col("value"), F.col("_prompt"), F.col("field"), noise)).where("disclosed is not null")


def _union(arrays: Column) -> Column:
    return F.array_distinct(F.flatten(arrays))


def legal_gate(cases: DataFrame, facts: DataFrame, case: str, prompt: str, draft: str, noise: Sequence[str] = ()) -> DataFrame:
    """Per case: total, disclosed, matched, omitted, critical_omissions, contradictions,
    unsupported, failed_fields, disclosure_rate, recall, legal_pass and reasons.

    A fact counts where the prompt discloses it and is met by its field's own
    rule. A kind of claim that draft and disclosed facts both have without one in
    common is a contradiction, as is a polarity that prompt and draft don't share;
    a claim of the draft is unsupported that neither prompt nor any fact has.
    Rates without a base are null.
    """
    met = _met(cases, facts, case, prompt, draft, noise)
    judged = met.withColumn("matched", F.col("disclosed") & E.claim_match(F.col("field"), F.col("index"), F.col("value"), F.col("_draft")))
    judged = judged.withColumn("claims", T.typed_claims(F.col("value")))
    fields = judged.groupBy("_c", "field").agg(
        F.count("*").alias("total"),
        F.count_if("disclosed").alias("disclosed"),
        F.count_if("matched").alias("matched"),
        F.count_if(F.col("disclosed") & ~F.col("matched") & F.col("critical")).alias("critical_omissions"),
        _union(F.collect_set("claims")).alias("claims"),
        _union(F.collect_set(F.when(F.col("disclosed"), F.col("claims")))).alias("expected"),
    )
    sums = fields.groupBy(F.col("_c")).agg(
        *(F.sum(c).alias(c) for c in ("total", "disclosed", "matched", "critical_omissions")),
        F.count_if(F.col("matched") < F.col("disclosed")).alias("failed_fields"),
        _union(F.collect_set("claims")).alias("_gold"),
        _union(F.collect_set("expected")).alias("_expected"),
    )
    none = F.expr("cast(array() as array<string>)")
    rows = cases.select(F.col(case), prompt, draft).join(sums, F.col(case) == F.col("_c"), "left")
    kind = lambda a: F.array_distinct(F.transform(a, lambda x: F.substring_index(x, ":", 1)))
    of = lambda a, k: F.filter(a, lambda x: F.substring_index(x, ":", 1) == k)
    rows = rows.select(
        case,
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "disclosed", "matched", "critical_omissions", "failed_fields")),
        F.coalesce("_gold", none).alias("_gold"),
        F.coalesce("_expected", none).alias("_expected"),
        T.typed_claims(F.col(draft)).alias("_said"),
        T.typed_claims(F.col(prompt)).alias("_asked"),
        F.size(E.polarity_conflicts(F.col(prompt), F.col(draft))).alias("_polarity"),
    )
    clash = F.filter(F.array_intersect(kind(F.col("_expected")), kind(F.col("_said"))), lambda k: ~F.arrays_overlap(of("_expected", k), of("_said", k)))
    rows = rows.withColumn("contradictions", (F.size(clash) + F.col("_polarity")).cast("long"))
    rows = rows.withColumn("unsupported", F.size(F.array_except("_said", F.array_union("_asked", "_gold"))).cast("long"))
    count = lambda name, label: F.when(F.col(name) > 0, F.concat(F.lit(f"{label}="), F.col(name).cast("string")))
    reasons = F.array_compact(F.array(count("critical_omissions", "critical_omissions"), count("contradictions", "critical_contradictions"), count("unsupported", "unsupported_additions")))
    failed = (F.size(reasons) == 0) & (F.col("failed_fields") > 0)
    reasons = F.when(failed, F.array(F.lit("critical_field_failure"))).otherwise(reasons)
    return rows.select(
        case, "total", "disclosed", "matched", (F.col("disclosed") - F.col("matched")).alias("omitted"), "critical_omissions", "contradictions", "unsupported", "failed_fields",
        F.try_divide(F.col("disclosed").cast("double"), "total").alias("disclosure_rate"),
        F.try_divide(F.col("matched").cast("double"), "disclosed").alias("recall"),
        (F.size(reasons) == 0).alias("legal_pass"), reasons.alias("reasons"),
    )


def long_words(text: Column) -> Column:
    """Words of over two letters, repeats included."""
    return F.filter(F.split(T.comparison_form(text), " "), lambda w: F.length(w) > 2)


def multiset_recall(expected: Column, candidate: Column) -> Column:
    """Share of the expected words, each as often as it stands there, that the candidate has; 0 without words."""
    times = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    hits = F.aggregate(F.array_distinct(expected), F.lit(0), lambda s, w: s + F.least(times(expected, w), times(candidate, w)))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(expected)), F.lit(0.0))


def factual_fidelity(cases: DataFrame, facts: DataFrame, case: str, prompt: str, draft: str, noise: Sequence[str] = ()) -> DataFrame:
    """Per case: fidelity, applicable_fields, reference_claims, candidate_claims, tp, fp, fn, precision, recall, f1.

    Means are rounded to twelve digits, so that they do not depend on the order of rows.
    A disclosed fact scores by its words and, where it names material claims, by
    those; a field is the mean of its facts, fidelity the mean of the fields.
    Claims of all disclosed facts are compared with the draft's as sets.
    """
    words = cases.select(case, prompt, draft, long_words(F.col(draft)).alias("_words"), D.material_claims(F.col(draft)).alias("_said"))
    met = _met(words, facts, case, prompt, draft, noise).where("disclosed").select("_c", "field", "value")
    own = words.select(F.col(case).alias("_k"), "_words", "_said")
    met = met.join(own, F.col("_c") == F.col("_k"))
    claims = D.material_claims(F.col("value"))
    met = met.withColumn("claims", claims)
    claim_recall = F.try_divide(F.size(F.array_intersect("claims", "_said")).cast("double"), F.size("claims"))
    met = met.withColumn("score", E.fact_score(multiset_recall(long_words(F.col("value")), F.col("_words")), claim_recall))
    fields = met.groupBy("_c", "field").agg(F.round(F.avg("score"), 12).alias("score"), _union(F.collect_set("claims")).alias("claims"))
    sums = fields.groupBy("_c").agg(F.round(F.avg("score"), 12).alias("fidelity"), F.count("*").alias("applicable_fields"), _union(F.collect_set("claims")).alias("_gold"))
    rows = words.select(case, "_said").join(sums, F.col(case) == F.col("_c"), "left")
    rows = rows.withColumn("_gold", F.coalesce("_gold", F.expr("cast(array() as array<string>)")))
    s = E.set_scores(F.col("_said"), F.col("_gold"))
    return rows.select(case, "fidelity", F.coalesce("applicable_fields", F.lit(0)).alias("applicable_fields"), F.size("_gold").alias("reference_claims"), F.size("_said").alias("candidate_claims"), *(s[c].alias(c) for c in s))
