"""The legal gate and factual fidelity against plain loops and worked cases."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glosswork.functions import decrees as D
from glosswork.functions import text as T
from glosswork.operators import evaluation as E
from glosswork.operators import legal as L

CASES = [
    ("good", "Aprobar el gasto de la obra según Decreto 12/2005 en el plazo de 30 días.", "Apruébase el gasto de la obra, Decreto 12/2005, plazo de 30 dias habiles para aprobar."),
    ("late", "Aprobar el gasto de la obra en el plazo de 30 días.", "Aprobar el gasto de la obra en el plazo de 60 dias."),
    ("invented", "Aprobar el gasto de la obra.", "Aprobar el gasto de la obra según Ley 99/2001."),
    ("omitted", "Designar personal de planta y aprobar el gasto.", "Texto sin relación alguna."),
    ("silent", "Un texto cualquiera.", "Otro."),
    ("empty", "", ""),
]
FACTS = [
    ("good", "normas_citadas", "0", "Decreto 12/2005", True), ("good", "objeto", "1", "aprobar el gasto de la obra", True), ("good", "dependencia", "2", "Poder Ejecutivo", True),
    ("late", "fecha_plazo_vigencia", "0", "plazo de 30 dias", True), ("invented", "objeto", "0", "aprobar el gasto", True),
    ("omitted", "objeto", "0", "designar personal de planta", True), ("omitted", "objeto", "1", "aprobar el gasto", False), ("silent", "objeto", "0", "nada que ver con esto", True),
]


def tables(spark):
    return spark.createDataFrame(CASES, "k string, p string, d string"), spark.createDataFrame(FACTS, "k string, field string, index string, value string, critical boolean")


def test_gate(spark):
    got = {r.k: r for r in L.legal_gate(*tables(spark), "k", "p", "d", noise=["poder ejecutivo"]).collect()}
    assert len(got) == len(CASES)
    good = got["good"]
    assert (good.total, good.disclosed, good.matched, good.legal_pass, good.reasons) == (2, 2, 2, True, [])
    late = got["late"]
    assert late.contradictions >= 1 and late.unsupported == 1 and not late.legal_pass
    assert got["invented"].reasons == ["unsupported_additions=1"] and got["invented"].recall == 1.0
    omitted = got["omitted"]
    assert (omitted.disclosed, omitted.matched, omitted.omitted, omitted.critical_omissions, omitted.failed_fields) == (2, 0, 2, 1, 1)
    assert "critical_omissions=1" in omitted.reasons
    silent = got["silent"]
    assert (silent.total, silent.disclosed, silent.recall, silent.disclosure_rate, silent.legal_pass) == (1, 0, None, 0.0, True)
    assert (got["empty"].total, got["empty"].disclosure_rate, got["empty"].legal_pass) == (0, None, True)


def test_gate_counts_equal_a_loop(spark):
    """Facts judged one by one by the library's rules and counted here."""
    cases, facts = tables(spark)
    met = facts.join(cases, "k").select("*", E.disclosed(F.col("value"), F.col("p")).alias("shown"), E.claim_match(F.col("field"), F.col("index"), F.col("value"), F.col("d")).alias("hit")).collect()
    got = {r.k: r for r in L.legal_gate(cases, facts, "k", "p", "d").collect()}
    for k, _, _ in CASES:
        own = [r for r in met if r.k == k]
        shown = [r for r in own if r.shown]
        hits = [r for r in shown if r.hit]
        assert (got[k].total, got[k].disclosed, got[k].matched) == (len(own), len(shown), len(hits))
        assert got[k].failed_fields == len({r.field for r in shown} - {f for f in {r.field for r in shown} if all(r.hit for r in shown if r.field == f)})


def words(text, spark):
    form = spark.createDataFrame([(text,)], "t string").select(T.comparison_form(F.col("t"))).first()[0]
    return Counter(w for w in form.split() if len(w) > 2)


def test_fidelity(spark):
    cases, facts = tables(spark)
    claims = lambda text: set(spark.createDataFrame([(text,)], "t string").select(D.material_claims(F.col("t"))).first()[0])
    got = {r.k: r for r in L.factual_fidelity(cases, facts, "k", "p", "d").collect()}
    shown = {(r.k, r.value) for r in facts.join(cases, "k").where(E.disclosed(F.col("value"), F.col("p"))).collect()}
    for k, _, draft in CASES:
        own = [f for f in FACTS if (k, f[3]) in shown]
        said, held = claims(draft), words(draft, spark)
        fields = {}
        for _, field, _, value, _ in own:
            asked, need = words(value, spark), claims(value)
            score = sum((asked & held).values()) / sum(asked.values()) if asked else 0.0
            fields.setdefault(field, []).append(0.65 * score + 0.35 * len(need & said) / len(need) if need else score)
        means = [sum(v) / len(v) for v in fields.values()]
        assert got[k].fidelity == (pytest.approx(sum(means) / len(means)) if means else None)
        gold = set().union(*(claims(f[3]) for f in own)) if own else set()
        assert (got[k].applicable_fields, got[k].reference_claims, got[k].candidate_claims) == (len(fields), len(gold), len(said))
        assert (got[k].tp, got[k].fp, got[k].fn) == (len(gold & said), len(said - gold), len(gold - said))


def test_entities(spark):
    """Every kind of entity, in the order of the text's kinds, noise left out."""
    text = "La Ley N° 25.506 y el Expediente EX-2020-1. La Corte Suprema, el Ministerio de Economía y el Dr. Juan Pérez; ANSES, PDF."
    found = [tuple(x)[:2] for x in spark.createDataFrame([(text,)], "t string").select(T.entities(F.col("t"))).first()[0]]
    kinds = [k for k, _ in found] if found and re.fullmatch("[A-Z_]+", found[0][0]) else [k for _, k in found]
    assert {"LEGAL_INSTRUMENT", "CASE", "COURT", "ORGANIZATION", "PERSON"} <= set(kinds)
    joined = " ".join(map(str, found))
    assert "Juan Pérez" in joined and "ANSES" in joined and "PDF" not in joined
