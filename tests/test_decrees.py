"""What decrees say, on a written decree and on odd texts."""

import json

from pyspark.sql import functions as F

from glosswork.functions import decrees as D
from glosswork.functions import nested as N

DECREE = """BOLETÍN OFICIAL
MINISTERIO DE ECONOMÍA
Decreto N° 12/2021
Apruébase el programa de becas.
Buenos Aires, 03/05/2021
VISTO: el Expediente EX-2021-77 y la Ley N° 27.541
CONSIDERANDO:
Que el presupuesto vigente alcanza para atender el gasto de la medida.
Que corto.
Que por el Decreto Nº 12/21 se   establece el plazo de treinta (30) días
hábiles. Firmado por la autoridad.
Por ello,
EL PRESIDENTE DECRETA:
Artículo 1º — Apruébase el programa del Decreto N° 12/2021.
Artículo 2º — Dase por prorrogada la vigencia según el artículo 7, inciso 2.
Artículo 3º — Comuníquese.
"""


def value(spark, text, *columns):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(*(c(F.col("t")).alias(str(i)) for i, c in enumerate(columns))).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_material_claims(spark):
    text = "Ley N° 027541 y Decreto 12/2021, el 03 de Mayo de 2021 o 3/05/21; plazo de 30 días, Expediente N° EX-2021-77, artículo 07, inciso 2 y artículo 9"
    assert value(spark, text, D.material_claims) == sorted(
        ["norma:ley:27541:-", "norma:decreto:12:2021", "fecha:3:mayo:2021", "fecha_num:3:5:21", "plazo:30:dias", "expediente:ex202177", "articulo:7:2", "articulo:9:-"]
    )
    assert value(spark, "", D.material_claims) == [] and value(spark, None, D.material_claims) is None


def test_legal_fields_and_canonical_forms(spark):
    text = "Ley N° 27.541, ley N° 27.541, Decreto-Ley 5/99. Ley N° 27.541. El 2021-05-03, por treinta días. art. 5 apartado b"
    got = value(spark, text, D.legal_fields)
    assert got == {"norma": ["Ley N° 27.541", "ley N° 27.541", "Decreto-Ley 5/99"], "fecha": ["2021-05-03"], "plazo": ["por treinta días"], "referencias": ["art. 5 apartado b"]}
    assert value(spark, text, lambda t: D.canonical_fields(D.legal_fields(t))) == {"norma": ["ley:27541:-", "ley:27541:-", "decreto_ley:5:99"], "fecha": ["2021-05-03"], "plazo": ["30:day"], "referencias": ["article:5:b"]}
    assert value(spark, "", D.legal_fields) == {}
    assert [value(spark, t, D.canonical_term) for t in ("noventa (060) meses", "2 semanas", "varios días", "nada")] == ["60:month", "2:week", None, None]
    assert [value(spark, t, D.canonical_file) for t in ("Expediente N° s01:77/21", "a-b", "ab-c")] == ["S017721", None, "ABC"]
    assert [value(spark, t, D.canonical_reference) for t in ("Artículo 3 y art. 04", "El Anexo", "…")] == ["article:3:-|article:4:-", "el anexo", None]
    assert value(spark, "Constitución Nacional", D.canonical_norms) == ["constitucion nacional"]


def test_reference_facts(spark):
    got = {f.fact_id: (f.field, f.text) for f in value(spark, DECREE.replace("º —", " —"), D.reference_facts)}
    assert got["organismo"] == ("organismo", "MINISTERIO DE ECONOMÍA")
    assert got["objeto"] == ("objeto", "Apruébase el programa de becas.")
    assert got["fecha"] == ("fecha_plazo_vigencia", "Buenos Aires, 03/05/2021")
    assert [got[f"dependencia-{i}"][1] for i in range(4)] == ["BOLETÍN OFICIAL", "MINISTERIO DE ECONOMÍA", "CONSIDERANDO:", "EL PRESIDENTE DECRETA:"]
    assert [v[1] for k, v in got.items() if k.startswith("norma")] == ["12 2021", "12 21", "27"]
    assert [got[f"articulo-{i}"][1] for i in (1, 3)] == ["Apruébase el programa del Decreto N° 12/2021.", "Comuníquese."]
    assert got["articulo-7"][1] == ", inciso 2."
    # an ordinal sign is a letter: with it, no article ends at the next one
    joined = {f.fact_id: f.text for f in value(spark, DECREE, D.reference_facts)}
    assert "Artículo 2º — Dase" in joined["articulo-1"] and "articulo-2" not in joined
    assert [v[1] for k, v in got.items() if k.startswith("critico")][0].endswith("Dase por prorrogada la vigencia según el artículo 7, inciso 2")
    assert value(spark, "", D.reference_facts) == [] and value(spark, None, D.reference_facts) is None


def test_prompt_parts(spark):
    df = spark.createDataFrame([(DECREE,), ("",), ("Una nota sin número\nVISTO: el pedido\nPor ello, nada",), (None,)], "t string")
    rows = [r.asDict() for r in df.select(*(c.alias(k) for k, c in D.prompt_parts(F.col("t")).items())).collect()]
    assert rows[0] == {
        "target": "12/2021",
        "organisation": "MINISTERIO DE ECONOMÍA",
        "objective": "aprobar el programa de becas",
        "facts": ["El presupuesto vigente alcanza para atender el gasto de la medida.", "Por el la medida proyectada se establece el plazo de treinta (30) días hábiles. [DATO EXCLUIDO] por la autoridad."],
        "requirements": ["Artículo funcional 1: Aprobar el programa del la medida proyectada.", "Artículo funcional 2: Prorrogar la vigencia según el artículo 7, inciso 2."],
    }
    assert rows[1] == {"target": D.NO_TARGET, "organisation": D.NO_ORGANISATION, "objective": D.NO_OBJECTIVE, "facts": [], "requirements": []}
    assert rows[2]["facts"] == [D.VISTO_FACT + "El pedido"]
    assert set(rows[3].values()) == {None}


def test_sentence_ends_at_a_full_stop(spark):
    late, early = "a" * 200 + ". " + "b" * 600, "a" * 50 + ". " + "b" * 700
    assert value(spark, late, D.sentence) == "A" + "a" * 199 + "."
    assert value(spark, early, D.sentence) == "A" + "a" * 49 + ". " + "b" * (620 - 52)


def test_top_by_terms(spark):
    items = [f"x{i}" for i in range(9)] + ["plazo y cargo", "PLAZO"]
    df = spark.createDataFrame([(items,)], "t array<string>")
    assert df.select(D.top_by_terms(F.col("t"))).first()[0] == [f"x{i}" for i in range(6)] + ["plazo y cargo", "PLAZO"]


def test_evidence(spark):
    trace = {
        "trace_id": "t1",
        "references": [{"id": "r", "text": "not this"}],
        "chunks": [{"text": " a  b "}, {"chunk_id": "c", "content": "x", "metadata": {"source": "s"}}, {"id": "f", "text": "y", "filtered": True}, {"id": "g", "text": "y", "selected": False}, {"id": "k", "text": "y", "kind": "was filtered"}, "bare", {"chunk_id": "c", "content": "x"}],
        "evidence": {"items": [{"text": "deep", "run_id": "t2"}]},
    }
    texts = [json.dumps(trace), json.dumps([{"text": "no origin"}]), "not json", '"bare"', "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.e for r in df.select("i", N.evidence()("t").alias("e")).collect()}
    assert [tuple(e) for e in got[0]] == [("t1:chunk-1", None, "a b", "t1"), ("c", "s", "x", "t1"), ("t2:chunk-4", None, "deep", "t2")]
    assert [got[i] for i in range(1, 6)] == [[], None, [], None, None]
