"""Evaluators: claims, fields, faithfulness, structure, legal gate, fidelity.

A metric that cannot be computed stays null and a status column says why; it is
never replaced by zero, so averages leave it out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import decrees as D
from glosswork.functions import text as T


def status(value: Column, has_gold: Column) -> Column:
    return F.when(~has_gold, "NOT_CALCULABLE").when(value.isNull(), "PARTIAL").otherwise("CALCULATED")


def set_scores(predicted: Column, gold: Column) -> dict[str, Column]:
    """tp, fp, fn, precision, recall, f1 of two arrays; ratios null where undefined."""
    tp = F.size(F.array_intersect(predicted, gold))
    fp, fn = F.size(F.array_except(predicted, gold)), F.size(F.array_except(gold, predicted))
    p, r = F.try_divide(tp.cast("double"), tp + fp), F.try_divide(tp.cast("double"), tp + fn)
    return {"tp": tp, "fp": fp, "fn": fn, "precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r))}


def greedy_match(pairs: DataFrame, case: str, gold: str, predicted: str) -> DataFrame:
    """case, tp, fp, fn: each gold item takes the first free prediction that shares a key with it.

    gold and predicted are arrays of arrays of keys. The order matters, so it is
    a fold over the gold items of one row that carries the taken predictions.
    """
    taken = F.expr("cast(array() as array<int>)")

    def step(acc, keys):
        free = F.filter(F.transform(F.col(predicted), lambda p, i: F.when(F.arrays_overlap(p, keys) & ~F.array_contains(acc, i), i)), lambda i: i.isNotNull())
        return F.when(F.size(free) > 0, F.concat(acc, F.slice(free, 1, 1))).otherwise(acc)

    tp = F.size(F.aggregate(F.col(gold), taken, step))
    return pairs.select(case, tp.alias("tp"), (F.size(predicted) - tp).alias("fp"), (F.size(gold) - tp).alias("fn"))


def contradictions(claims: DataFrame, case: str) -> DataFrame:
    """Pairs of a case's claims with equal subject and predicate but other object or polarity.

    claims: case, pos, subject, predicate, object, polarity. The base key is an
    equi-join key; equal claims collapse before.
    """
    base = claims.where("predicate <> ''").groupBy(case, "subject", "predicate", "object", "polarity").agg(F.min("pos").alias("pos"))
    a, b = base.alias("a"), base.alias("b")
    same = (F.col(f"a.{case}") == F.col(f"b.{case}")) & (F.col("a.subject") == F.col("b.subject")) & (F.col("a.predicate") == F.col("b.predicate"))
    differ = (F.col("a.object") != F.col("b.object")) | (F.col("a.polarity") != F.col("b.polarity"))
    return a.join(b, same & (F.col("a.pos") < F.col("b.pos")) & differ).select(F.col(f"a.{case}").alias(case), F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), F.col("a.subject").alias("subject"), F.col("a.predicate").alias("predicate"))


def answer_claims(text: Column) -> Column:
    """Sentences of an answer without links, citations and bullets; under two words dropped, the first of equal token strings kept."""
    parts = F.split(text, r"(?<=[.!?。！？])\s+|[\n;]+")
    plain = F.transform(parts, lambda s: F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"\[\d+\]", ""), r"^\s*(?:[-*•]|\d+[.)])\s+", "")))
    kept = F.filter(plain, lambda s: F.size(F.split(s, r"\s+")) >= 2)
    keyed = F.transform(kept, lambda s: F.struct(s.alias("text"), T.comparison_form(s).alias("key")))
    return F.transform(T.first_by_key(keyed), lambda x: x["text"])


def entailment(claims: Column, evidence: Column, threshold: float = 0.8) -> dict[str, Column]:
    """faithfulness (supported share) and groundedness (mean best recall) of claims against evidence texts."""
    best = F.transform(claims, lambda c: F.coalesce(F.array_max(F.transform(evidence, lambda e: T.token_recall(c, e))), F.lit(0.0)))
    n = F.size(claims)
    supported = F.size(F.filter(best, lambda b: b >= threshold))
    total = F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
    return {"faithfulness": F.try_divide(supported.cast("double"), n), "groundedness": F.try_divide(total, n.cast("double"))}


# Patterns of deontic modes and of negation.
MODES = [
    ("obligation", r"(?i)\b(?:debe|debera|obligad[oa])\b"),
    ("prohibition", r"(?i)\b(?:prohibe|prohibir|prohibido|no\s+(?:puede|podra|autoriza|permite))\b"),
    ("permission", r"(?i)\b(?:puede|podra|autoriza|permite)\b"),
]
NEGATED = r"(?i)\bno\s+(?:se\s+)?(?:autoriza|permite|debe|puede|podra|debera)\b"


def modality(text: Column) -> Column:
    plain = T.strip_accents(text)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(MODES):
        out = F.when(plain.rlike(pattern), name).otherwise(out)
    return out


def polarity_conflicts(gold: Column, candidate: Column) -> Column:
    """Codes of contradictions between texts that share two words at least."""
    a, b = T.strip_accents(gold), T.strip_accents(candidate)
    shared = F.size(F.array_intersect(T.token_set(gold), T.token_set(candidate))) >= 2
    na, nb = a.rlike(NEGATED), b.rlike(NEGATED)
    ma, mb = modality(gold), modality(candidate)
    codes = F.array(F.when(na != nb, "negation"), F.when(ma.isNotNull() & mb.isNotNull() & (ma != mb), "deontic_modality"))
    return F.when(shared, F.array_compact(codes)).otherwise(F.array().cast("array<string>"))


# Words of exception, and the recall at which a field's value counts as met.
EXCEPTION = r"(?i)\b(?:salvo|excepto|exceptua|exceptuando)\b"
MET_AT = {"normas_citadas": 0.85, "fecha_plazo_vigencia": 0.8, "dependencia": 0.75}
DISCLOSED_AT = 0.42


def disclosed(value: Column, prompt: Column, field: Column | None = None, noise: Sequence[str] = ()) -> Column:
    """Whether the prompt gives a gold value away; null for a dependency that is noise."""
    recall = T.token_recall(value, prompt)
    if field is None or not noise:
        return recall >= DISCLOSED_AT
    plain = [T.comparison_form(F.lit(n)) for n in noise]
    return F.when((field == "dependencia") & T.comparison_form(value).isin(*plain), None).otherwise(recall >= DISCLOSED_AT)


def claim_match(field: Column, index: Column, value: Column, candidate: Column) -> Column:
    """Whether a candidate text meets a gold value, by the field's own rule.

    Norms and dates are met by a typed claim in common or by recall; an article's
    number must appear besides; a dependency may stand as it is. An exception in
    the value must be one in the candidate.
    """
    recall = T.token_recall(value, candidate)
    typed = T.typed_claims(candidate)
    shared = F.arrays_overlap(T.typed_claims(value), typed)
    lost = T.strip_accents(value).rlike(EXCEPTION) & ~T.strip_accents(candidate).rlike(EXCEPTION)
    met = F.when(field == "articulos_resolutivos", F.array_contains(typed, F.concat(F.lit("articulo:"), index)) & (recall >= DISCLOSED_AT))
    met = met.when(field == "dependencia", T.comparison_form(candidate).contains(T.comparison_form(value)) | (recall >= MET_AT["dependencia"]))
    for name in ("normas_citadas", "fecha_plazo_vigencia"):
        met = met.when(field == name, shared | (recall >= MET_AT[name]))
    return ~lost & met.otherwise(recall >= DISCLOSED_AT)


# Words that do not count when a fact is sought in a draft.
FACT_STOPWORDS = (
    "a", "al", "ante", "con", "contra", "de", "del", "desde", "durante", "e", "el", "en", "entre", "es", "esta", "este", "la", "las", "lo", "los", "para", "por", "que",
    "se", "su", "sus", "un", "una", "y", "o", "u", "como", "dicho", "dicha", "presente", "medida", "mismo", "misma", "segun", "decreto", "articulo", "articulos", "art",
    "nro", "nros", "numero", "numeros",
)


def reference_coverage(cases: DataFrame, case: str, reference: str, draft: str, threshold: float = 0.65, critical: bool = True) -> DataFrame:
    """case, fact_id, field, covered: whether a draft holds each fact of its published decree (see reference_facts).

    A fact is held if it stands there as it is or the share of its words (over two
    letters, no stop word) that the draft has reaches the threshold; one without
    such words is not. The draft and each fact are normalised once.
    """
    words = lambda plain: F.filter(F.array_distinct(F.split(plain, " ")), lambda w: (F.length(w) > 2) & ~w.isin(*FACT_STOPWORDS))
    held = cases.select(F.col(case), T.comparison_form(F.col(draft)).alias("_plain"), D.reference_facts(F.col(reference), critical=critical).alias("_facts"))
    rows = held.select(case, "_plain", words(F.col("_plain")).alias("_words"), F.inline_outer("_facts")).where("fact_id is not null")
    rows = rows.select(case, "fact_id", "field", "_plain", "_words", T.comparison_form(F.col("text")).alias("_fact"))
    rows = rows.select("*", words(F.col("_fact")).alias("_own"))
    n = F.size("_own")
    covered = (n > 0) & (F.contains("_plain", "_fact") | (F.try_divide(F.size(F.array_intersect("_own", "_words")), n) >= threshold))
    return rows.select(case, "fact_id", "field", F.coalesce(covered, F.lit(False)).alias("covered"))


def value_match(gold: Column, predicted: Column) -> dict[str, Column]:
    """tp, fp, fn, precision, recall, f1, exact of two arrays in which values may repeat."""
    times = lambda a, v: F.size(F.filter(a, lambda x: x == v))
    tp = F.aggregate(F.array_distinct(gold), F.lit(0), lambda s, v: s + F.least(times(gold, v), times(predicted, v)))
    fp, fn = F.size(predicted) - tp, F.size(gold) - tp
    p, r = F.try_divide(tp.cast("double"), tp + fp), F.try_divide(tp.cast("double"), tp + fn)
    return {"tp": tp, "fp": fp, "fn": fn, "precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)), "exact": (fp == 0) & (fn == 0)}


def legal_core(cases: DataFrame, case: str, candidate: str, gold: str, prompt: str, disclosed_at: float = 0.42) -> DataFrame:
    """Per case: prompt recall, match, unsupported and conflicting claims, and the gate."""
    c, g, p = T.typed_claims(F.col(candidate)), T.typed_claims(F.col(gold)), T.typed_claims(F.col(prompt))
    rows = cases.select(case, c.alias("c"), F.array_union(g, p).alias("allowed"), g.alias("g"), T.token_recall(F.col(gold), F.col(prompt)).alias("prompt_recall"), T.token_recall(F.col(gold), F.col(candidate)).alias("recall"), polarity_conflicts(F.col(gold), F.col(candidate)).alias("conflicts"))
    kind = lambda a: F.array_distinct(F.transform(a, lambda x: F.substring_index(x, ":", 1)))
    both = F.array_intersect(kind(F.col("c")), kind(F.col("g")))
    clash = F.filter(both, lambda k: ~F.arrays_overlap(F.filter("c", lambda x: x.startswith(F.concat(k, F.lit(":")))), F.filter("g", lambda x: x.startswith(F.concat(k, F.lit(":"))))))
    rows = rows.select(case, "prompt_recall", "recall", (F.col("prompt_recall") >= disclosed_at).alias("disclosed"), F.size(F.array_except("c", "allowed")).alias("n_unsupported"), (F.size(clash) + F.size("conflicts")).alias("n_conflicts"))
    matched = F.col("recall") >= disclosed_at
    return rows.withColumn("legal_pass", (~F.col("disclosed") | matched) & (F.col("n_unsupported") == 0) & (F.col("n_conflicts") == 0))


def fact_score(recall: Column, claim_recall: Column) -> Column:
    """0.65 of the token recall and 0.35 of the claim recall; the former alone without claims."""
    return F.when(claim_recall.isNull(), recall).otherwise(0.65 * recall + 0.35 * claim_recall)


def rating(score: Column) -> Column:
    out = F.lit(1)
    for cut, stars in ((0.40, 2), (0.60, 3), (0.75, 4), (0.90, 5)):
        out = F.when(score >= cut, stars).otherwise(out)
    return F.when(score.isNotNull(), out)


def field_status(gold: Column, predicted: Column) -> Column:
    """CORRECT, PARTIAL, INCORRECT, MISSING, NOT_APPLICABLE or NOT_CALCULABLE of two value arrays."""
    na = lambda a: F.exists(a, lambda x: F.upper(F.trim(x)).isin("N/A", "NA", "NOT_APPLICABLE"))
    hit = F.size(F.array_intersect(gold, predicted))
    return (
        F.when(gold.isNull(), "NOT_CALCULABLE")
        .when(na(gold), "NOT_APPLICABLE")
        .when(predicted.isNull() | (F.size(predicted) == 0) & (F.size(gold) > 0), "MISSING")
        .when((hit == F.size(gold)) & (hit == F.size(predicted)), "CORRECT")
        .when(hit > 0, "PARTIAL")
        .otherwise("INCORRECT")
    )


def required_paths(json_text: Column, paths: Sequence[str]) -> Column:
    """Share of the JSON paths that are there and not empty."""
    filled = [F.coalesce(~F.trim(F.get_json_object(json_text, p)).isin("", "[]", "{}", "null"), F.lit(False)).cast("int") for p in paths]
    return sum(filled, F.lit(0)) / F.lit(float(len(paths)))


def citation_scores(cited: Column, retrieved: Column, expected: Column) -> dict[str, Column]:
    cited = F.array_distinct(cited)
    good = F.size(F.array_intersect(cited, retrieved)).cast("double")
    return {
        "traceability": F.coalesce(F.try_divide(good, F.size(cited)), F.lit(0.0)),
        "invented": F.try_divide(F.size(cited) - good, F.size(cited)),
        "recall": F.try_divide(F.size(F.array_intersect(cited, expected)).cast("double"), F.size(expected)),
    }


def json_kind(text: Column) -> Column:
    """object, array, string, number, integer, boolean, null; null for invalid JSON."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind == "BIGINT", "integer").when(kind.isNotNull(), "number")
    )


def schema_errors(schema: dict):
    """A function of JSON text: the number of violations of a JSON Schema (a subset), null for text that is not JSON."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("int")
    def check(texts):
        import json
        import re

        import pandas as pd

        kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}

        def is_kind(v, k):
            if k in ("number", "integer"):
                return isinstance(v, (int, float)) and not isinstance(v, bool) and (k == "number" or float(v).is_integer())
            return isinstance(v, kinds[k])

        def errors(v, s, root):
            if "$ref" in s:
                node = root
                for part in s["$ref"].lstrip("#/").split("/"):
                    node = node[part]
                return errors(v, node, root)
            n = int("const" in s and v != s["const"]) + int("enum" in s and v not in s["enum"])
            want = s.get("type")
            if want and not any(is_kind(v, k) for k in ([want] if isinstance(want, str) else want)):
                return n + 1
            if isinstance(v, dict):
                n += sum(k not in v for k in s.get("required", []))
                known = s.get("properties", {})
                n += sum(errors(v[k], known[k], root) for k in known if k in v)
                if s.get("additionalProperties") is False:
                    n += sum(k not in known for k in v)
            if isinstance(v, list):
                n += int(len(v) < s.get("minItems", 0)) + int(len(v) > s.get("maxItems", len(v)))
                n += int(bool(s.get("uniqueItems")) and len({json.dumps(x, sort_keys=True) for x in v}) < len(v))
                n += sum(errors(x, s["items"], root) for x in v) if "items" in s else 0
            if isinstance(v, str):
                n += int(len(v) < s.get("minLength", 0)) + int(len(v) > s.get("maxLength", len(v)))
                n += int("pattern" in s and not re.search(s["pattern"], v))
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                n += int(v < s.get("minimum", v)) + int(v > s.get("maximum", v))
            n += sum(errors(v, x, root) for x in s.get("allOf", []))
            n += int("anyOf" in s and not any(errors(v, x, root) == 0 for x in s["anyOf"]))
            n += int("oneOf" in s and sum(errors(v, x, root) == 0 for x in s["oneOf"]) != 1)
            return n + int("not" in s and errors(v, s["not"], root) == 0)

        def one(text):
            def no(x):
                raise ValueError(x)

            try:
                value = json.loads(text, parse_constant=no)
            except (TypeError, ValueError):
                return None
            return errors(value, schema, schema)

        return pd.Series([one(t) for t in texts], dtype="Int32")

    return check


def error_category(text: Column, rules: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """The label of the first pattern that matches."""
    out = F.lit(other)
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out
