"""Hand-computed values, random checks against plain Python, odd inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.operators import corpus as C
from glosswork.operators import evaluation as E
from glosswork.operators import overlap
from glosswork.operators import reconcile as Q
from glosswork.operators import relational as R
from glosswork.operators import retrieval as V
from glosswork.operators import resampling
from glosswork.operators import statistics as S
from glosswork.operators.ranks import group_position
from glosswork.sources import files


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_ranking_metrics(spark):
    gains = lambda *xs: F.array(*map(F.lit, xs))
    r = one(
        spark,
        ndcg=V.ndcg_at(gains(3.0, 0.0), gains(3.0, 1.0), 2),
        none=V.ndcg_at(gains(0.0), F.array().cast("array<double>"), 2),
        p=V.precision_at(gains(1, 2), gains(2), 3),
        w=V.precision_at(gains(1, 2), gains(2), 3, by_window=True),
        rr=V.reciprocal_rank(gains(1, 2), gains(2)),
        again=V.recall_at(gains(2, 2), gains(2, 3), 5, distinct=False),
        once=V.recall_at(gains(2, 2), gains(2, 3), 5),
    )
    assert r.ndcg == pytest.approx(0.8262346571, abs=1e-9) and r.none is None
    assert (r.p, r.w, r.rr, r.again, r.once) == pytest.approx((1 / 3, 0.5, 0.5, 1.0, 0.5))


def test_similarity(spark):
    rows = spark.createDataFrame([("a b c", "a c"), ("abc", "xyz"), ("", "a"), (None, "a"), ("x y x y", "y x y x")], "a string, b string")
    got = rows.select(T.rouge_l()("a", "b").alias("r"), T.chrf()("a", "b").alias("c")).collect()
    assert [round(g.r, 9) if g.r is not None else None for g in got] == [0.8, 0.0, 0.0, None, 0.75]
    assert got[1].c == 0.0 and got[3].c is None


def test_percentiles(spark):
    values = F.array(*map(F.lit, [1.0, 2.0, 3.0, 10.0]))
    r = one(spark, a=S.percentile_rounded(values, 0.5), c=S.percentile_nearest(values, 0.5), d=S.percentile_truncated(values, 0.5))
    assert (r.a, r.c, r.d) == (3.0, 2.0, 2.0)
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 3.0, 10.0)], "g string, v double")
    assert df.agg(S.percentile_linear("v", 0.5)).first()[0] == 2.5
    got = S.rank_percentiles(df, "g", "v", [0.5]).first()
    assert (got.rounded, got.nearest, got.truncated) == (3.0, 2.0, 2.0)


def test_holm(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "k int, p double")
    got = {r.k: r.p_holm for r in S.holm(df, [], "p", ["k"]).collect()}
    assert got == pytest.approx({1: 0.03, 3: 0.06, 2: 0.06})


def test_mcnemar(spark):
    pairs = [(True, False)] * 3 + [(False, True)] + [(True, True)] * 8
    df = spark.createDataFrame([(1, 2, i, a, b) for i, (a, b) in enumerate(pairs)], "run_a int, run_b int, c int, a boolean, b boolean")
    r = S.mcnemar(df).first()
    assert (r.only_a, r.only_b) == (3, 1) and r.p == pytest.approx(0.625)
    assert S.sign_tail(0, 0) == 1.0 and 0 < S.sign_tail(900, 2000) < 1e-4


def test_bootstrap_is_seeded(spark):
    df = spark.createDataFrame([("g", float(i % 7 - 2)) for i in range(400)], "g string, d double")
    a, b = (resampling.bootstrap(df, ["g"], "d", resamples=300).first() for _ in range(2))
    assert a == b and a.low < a["mean"] < a.high and a.p < 0.05


def test_diversify_equals_sequential(spark):
    rng = random.Random(1)
    for d, s in itertools.product((1, 2), repeat=2):
        rows = [(q, i, rng.randrange(3), rng.randrange(3)) for q in range(30) for i in range(1, 13)]
        df = spark.createDataFrame(rows, "q int, rank int, doc int, sec int")
        got = {(r.q, r["rank"]): r.disposition for r in V.diversify(df, "q", "doc", "sec", d, s).collect()}
        for q in range(30):
            docs, secs = {}, {}
            for _, i, doc, sec in (r for r in rows if r[0] == q):
                ok = docs.get(doc, 0) < d and secs.get((doc, sec), 0) < s
                assert got[q, i] == ("SELECTED" if ok else "EXCLUDED_DIVERSITY")
                if ok:
                    docs[doc], secs[doc, sec] = docs.get(doc, 0) + 1, secs.get((doc, sec), 0) + 1


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("g", 1, 40, 1), ("g", 2, 90, 1), ("g", 3, 50, 1)], "g string, i int, bytes int, tokens int")
    assert V.budget_pack(df, "g", "i", 96, 10).first().picked == [1, 3]


DECREE = """Decreto de prueba
VISTO el expediente 12
CONSIDERANDO:
Primer párrafo

Segundo párrafo largo largo
DECRETA:
ARTÍCULO 1°.- Uno
sigue

más
Art. ÚNICO - Dos
Comuníquese
Presidente Tal
Firmado Cual"""


def test_chunks(spark):
    got = C.chunks(spark.createDataFrame([(1, DECREE), (2, "plain\n\ntext")], "k int, t string"), "k", "t", 30).orderBy("k", "chunk_index").collect()
    first = [(r.kind, r.number, r.content) for r in got if r.k == 1]
    assert [x[0] for x in first] == ["TITLE", "VISTO", "CONSIDERANDO", "CONSIDERANDO", "DISPOSITIVE_INTRO", "ARTICLE", "ARTICLE", "CLOSING", "AUTHORITY", "SIGNATURE"]
    assert first[5] == ("ARTICLE", "1", "ARTÍCULO 1°.- Uno sigue\n\nmás") and first[6][1] == "ÚNICO"
    assert [(r.kind, r.content) for r in got if r.k == 2] == [("UNKNOWN", "plain\n\ntext")]


def test_normaliser(spark):
    text = "﻿Skip to content\r\nArticulo  1\tuno \x07\r\n\r\n\r\n\r\nfin\r"
    r = one(spark, n=T.normalize_corpus(F.lit(text))).n
    assert r.content == "ARTÍCULO 1 uno\n\nfin" and r.bom_removed and r.controls_removed == 1 and r.lines_removed == 1 and r.endings_changed
    assert one(spark, n=T.normalize_corpus(F.lit(" \n "))).n.content is None


def test_text_forms(spark):
    r = one(spark, a=T.comparison_form(F.lit("Órgano N° 3, Straße"), exact=True), b=T.semantic_form(F.lit("ﬁn Straße  x")), c=T.canonical_code(F.lit(" Ley Orgánica-2 ")))
    assert (r.a, r.b, r.c) == ("organo n 3 stra e", "fin strasse x", "ley_organica_2")


def test_claims(spark):
    text = "Decreto N° 0123/2020 y ley 5 de 99. El 03 de Mayo de 2021, 1/2/21; plazo de treinta (30) días hábiles. Art. 4, DNI 12345678, $ 1.200,50"
    got = one(spark, c=T.typed_claims(F.lit(text))).c
    assert {"norma:decreto:123/2020", "norma:ley:5/99", "fecha:3:mayo:2021", "fecha:1:2:21", "plazo:30:dias", "articulo:4", "dni:12345678", "monto:120050"} == set(got)
    atoms = one(spark, c=T.atomic_claims(F.lit("El juez debe firmar y no puede delegar. El juez debe firmar."))).c
    assert [(a.subject, a.predicate, a.object, a.polarity) for a in atoms] == [("el juez", "debe", "firmar", "AFFIRMED"), ("", "puede", "delegar", "NEGATED")]


def test_dates(spark):
    rows = spark.createDataFrame([(t,) for t in ("2020-02-30", "31/12/19", "3 de mayo de 2021", "x", "1-2-2020")], "t string")
    assert [str(r[0]) for r in rows.select(T.parse_date(F.col("t"))).collect()] == ["None", "2019-12-31", "2021-05-03", "None", "2020-02-01"]


def test_contained_equals_substring(spark):
    rng = random.Random(4)
    words = ["aa", "b", "cc", "d", "e"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)]
    items = [(j, " ".join(docs[rng.randrange(40)][1].split()[3 : 3 + n])) for j, n in enumerate([2, 5, 6, 7, 8, 12, 20, 7])] + [(99, "B CC")]
    got = {(r.k, r.j) for r in overlap.contained(spark.createDataFrame(docs, "k int, t string"), spark.createDataFrame(items, "j int, p string"), "k", "t", "j", "p").collect()}
    assert got == {(k, j) for k, t in docs for j, p in items if p.lower() in t.lower()}


def test_outcomes(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "x"), (5, "c", "z")]
    got = C.in_batch_outcomes(spark.createDataFrame(rows, "i int, k string, h string"), ["k"], "h", "i").orderBy("i").collect()
    assert [r.outcome for r in got] == ["CREATED", "UNCHANGED", "UPDATED", "DUPLICATE", "CREATED"]


def test_greedy_matching(spark):
    rows = spark.createDataFrame([("c", [["a", "b"], ["b"], ["z"]], [["b"], ["a"]])], "case string, gold array<array<string>>, predicted array<array<string>>")
    r = E.greedy_match(rows, "case", "gold", "predicted").first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 2)


def test_status_lattice(spark):
    rows = spark.createDataFrame([(None, ["a"]), (["N/A"], None), (["a"], None), (["a"], []), (["a"], ["a"]), (["a", "b"], ["a"]), (["a"], ["b"]), ([], [])], "g array<string>, p array<string>")
    got = [r[0] for r in rows.select(E.field_status(F.col("g"), F.col("p"))).collect()]
    assert got == ["NOT_CALCULABLE", "NOT_APPLICABLE", "MISSING", "MISSING", "CORRECT", "PARTIAL", "INCORRECT", "CORRECT"]


def test_json_schema(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"$ref": "#/defs/n"}, "b": {"type": "array", "items": {"enum": [1, 2]}, "uniqueItems": True}}, "additionalProperties": False, "defs": {"n": {"type": "integer", "minimum": 1}}}
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": 0, "c": 1}',), ('{"b": [1, 1, 3]}',), ("NaN",), ("{",), (None,)], "t string")
    assert [r[0] for r in rows.select(E.schema_errors(schema)("t")).collect()] == [0, 2, 3, None, None, None]


def test_fallback_and_gold(spark):
    items = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "i int, k string")
    catalog = spark.createDataFrame([("x", "v1"), ("y-base", "v2")], "k string, v string")
    got = {r.i: r.matched for r in Q.fallback_match(items, catalog, [F.col("k"), F.concat("k", F.lit("-base"))], "k", "v").collect()}
    assert got == {1: "v1", 2: "v2", 3: None}
    gold = spark.createDataFrame([("X", 1), ("x", 2)], "k string, g int")
    joined = Q.gold_join(items, gold, ["k"], [F.desc("g")]).orderBy("i").collect()
    assert [(r.g, r.reason) for r in joined] == [(2, None), (None, "gold_join_missing"), (None, "gold_join_missing")]


def test_positions(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(0, 30_000, 7)], "k long, g int")
    got = group_position(df, "g", "k", "pos", buckets=16).orderBy("g", "k").collect()
    for g in range(3):
        assert [r.pos for r in got if r.g == g] == list(range(sum(r.g == g for r in got)))


def test_state_machine(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "b")], "e int, t int, s string")
    allowed = spark.createDataFrame([("a", "b")], "from_status string, to_status string")
    bad = R.check_transitions(log, "e", [F.col("t")], "s", allowed).collect()
    assert [(r.e, r.t) for r in bad] == [(1, 3)]


def test_files(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes("é".encode("utf-16"))
    (tmp_path / "in/sub/b.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "in/c.exe").write_bytes(b"x")
    (tmp_path / "in/d.json").write_bytes(b"\xef\xbb\xbf{}")
    got = {r.identifier.rsplit("/")[-1]: (r.text, r.error) for r in files.decode(files.discover(spark, str(tmp_path / "in"))).collect()}
    assert got == {"a.txt": ("é", None), "b.txt": (None, "ENCODING"), "c.exe": (None, "EXTENSION"), "d.json": ("{}", None)}
    cases = tmp_path / "cases"
    cases.mkdir()
    (cases / "case-0001.json").write_text('{"case_number": 1}')
    (cases / "case-0002.json").write_text('{"case_number": 3}')
    assert {(r.file_number, r.matches) for r in files.read_cases(spark, str(cases)).collect()} == {(1, True), (2, False)}
    sidecar = files.with_metadata({"b": 1, "a": "ñ"})
    assert files.check_metadata(sidecar) and not files.check_metadata(sidecar | {"metadata": {}})
    df = spark.createDataFrame([(1, [1, 2], 'a "q", b\nc'), (2, None, None)], "k int, v array<int>, s string")
    files.write_csv(df, str(tmp_path / "t.csv"))
    assert files.read_any(spark, str(tmp_path / "t.csv")).where("k = 1").first().s == 'a "q", b\nc'
    checks = files.envelope_checks(df, "k", 2).first()
    assert (checks.n, checks.status) == (2, "FULL") and checks.records_sha256 == files.envelope_checks(df.orderBy(F.desc("k")), "k", 2).first().records_sha256


def test_filled_sample(spark):
    rows = [(i, "big") for i in range(500)] + [(1000 + i, "small") for i in range(2)] + [(2000 + i, None) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, g string")
    got = R.filled_sample(df, "g", "id", 60, 7).collect()
    count = {g: sum(r.g == g for r in got) for g in ("big", "small", None)}
    assert len(got) == len({r.id for r in got}) == 60 and count["small"] == 2 and count["big"] >= 20 and count[None] >= 20
    assert {r.id for r in got} == {r.id for r in R.filled_sample(df, "g", "id", 60, 7).collect()}
    assert R.filled_sample(df, "g", "id", 1000, 7).count() == 542 and R.filled_sample(df.where("id < 0"), "g", "id", 5, 7).count() == 0
