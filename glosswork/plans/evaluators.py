"""Evaluators over whole texts of documents and conversations, put together from their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswork.functions import decrees as D
from glosswork.functions import identity as ID
from glosswork.functions import nested as N
from glosswork.functions import text as T
from glosswork.functions.canonical import seal_holds, sealed
from glosswork.operators import evaluation as E
from glosswork.operators import fields as X
from glosswork.operators import inventory as I
from glosswork.operators import legal as L
from glosswork.operators import schema as S
from glosswork.operators import semantic as M
from glosswork.plans.evaluation import _turns
from glosswork.plans.registry import query
from glosswork.session import scratch
from glosswork.sources import cases as K
from glosswork.sources import files

#: Fields that any text may have: mail addresses, numbers of four digits or more, dotted numbers.
TEXT_FIELDS = {"mail": "[a-z0-9._-]+@[a-z0-9.-]+", "number": "[0-9]{4,}", "dotted": "[0-9]+[.][0-9]+[.][0-9]+"}

#: The same, tried only where a run of their first characters begins or a match has ended: in time linear in a run.
_TEXT_PATTERNS = {"mail": r"(?:\G|(?<![a-z0-9._-]))[a-z0-9._-]++@[a-z0-9.-]+", "number": "[0-9]{4,}", "dotted": r"(?<![0-9])[0-9]++[.][0-9]++[.][0-9]+"}


def _half(text):
    """The first half of a text's lines."""
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, 1, F.ceil(F.size(lines) / 2).cast("int")), "\n")


def _text_fields(text):
    found = {name: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0))) for name, p in _TEXT_PATTERNS.items()}
    found["mail"] = F.when(text.contains("@"), found["mail"])
    pairs = [x for name, values in found.items() for x in (F.lit(name), values)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.size(v) > 0)


_ALL = "list_distinct(regexp_extract_all({}, '{}'))"


def _field_sql(name, pattern):
    gold, part = _ALL.format("text", pattern), _ALL.format("half", pattern)
    return f"""SELECT doc_id, '{name}' AS field, len({gold}) AS n, len({part}) AS m, len(list_intersect({gold}, {part})) AS tp FROM d"""


@query("e03_text_fields", f"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
d AS (SELECT doc_id, text, array_to_string(ls[:CAST(ceil(len(ls) / 2) AS BIGINT)], chr(10)) AS half FROM l),
f AS ({" UNION ALL ".join(_field_sql(n, p) for n, p in TEXT_FIELDS.items())}),
s AS (SELECT *, CASE WHEN n = 0 THEN 'NOT_CALCULABLE' WHEN m = 0 THEN 'MISSING' WHEN tp = n AND m = n THEN 'CORRECT' WHEN tp > 0 THEN 'PARTIAL' ELSE 'INCORRECT' END AS status FROM f)
SELECT doc_id, field, status, CASE WHEN n > 0 AND m > 0 THEN tp END AS tp, CASE WHEN n > 0 THEN CASE WHEN m = 0 THEN 0.0 WHEN tp > 0 THEN round(2 * tp / (n + m), 9) END END AS accuracy FROM s""")
def text_fields(t):
    """How many of a text's fields the first half of its lines has: every field by the scorer's rules."""
    rows = t.documents.select("doc_id", _text_fields(F.col("text")).alias("gold"), T.let(_half(F.col("text")), _text_fields).alias("predicted"))
    scored = X.score_fields(rows, ["doc_id"], "gold", "predicted", [X.FieldSpec(n) for n in TEXT_FIELDS])
    # There is a field for each rule; of a plain inline() Spark infers a filter that computes them once more.
    return scored.select("doc_id", F.inline_outer("fields")).select("doc_id", "field", "status", F.col("tp").cast("long").alias("tp"), F.round("accuracy", 9).alias("accuracy"))


def _each(rule):
    """A rule for one value as one for all; null where a value can't be read."""
    return lambda values: F.when(~F.exists(F.transform(values, rule), lambda v: v.isNull()), F.transform(values, rule))


#: The five fields of legal drafts with their canonical forms and other names.
LEGAL_FIELDS = [
    X.FieldSpec("norma", normalise=lambda vs: F.array_sort(F.flatten(F.transform(vs, D.canonical_norms))), aliases=("normas", "normas_citadas", "marco_normativo", "legal_basis")),
    X.FieldSpec("fecha", aliases=("date", "fecha_emision", "fecha_vigencia", "fecha_plazo_vigencia")),
    X.FieldSpec("plazo", normalise=_each(D.canonical_term), aliases=("term", "duration", "deadline", "vigencia")),
    X.FieldSpec("expediente", normalise=_each(D.canonical_file), aliases=("case_number", "numero_expediente", "case_id")),
    X.FieldSpec("referencias", normalise=_each(D.canonical_reference), aliases=("referencias_normativas", "references", "articulos", "articulos_resolutivos", "article_references")),
]


@query("e03_legal_field_scores")
def legal_field_scores(t):
    """The legal fields of a document against those of the first half of its lines, joined with the totals."""
    rows = t.documents.select("doc_id", D.legal_fields(F.col("text")).alias("gold"), D.legal_fields(_half(F.col("text"))).alias("predicted"))
    return X.score_fields(rows, ["doc_id"], "gold", "predicted", LEGAL_FIELDS).drop("fields")


def _contexts(t):
    """Answers with a retrieval context whose chunks are the lines of the prompt."""
    lines = F.transform(F.split("prompt", "\n"), lambda x: F.struct(x.alias("text")))
    trace = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    context = F.struct(F.struct(trace.alias("trace_id"), lines.alias("chunks")).alias("rag_context"))
    return _turns(t).select("conv_id", "turn", "prompt", "answer", F.to_json(context).alias("context"))


@query("e05_x25_grounded_claims")
def grounded_claims(t):
    """Claims of an answer against the chunks of its context, by token recall without stop words."""
    rows = _contexts(t).select("conv_id", "turn", E.answer_claims(F.col("answer")).alias("claims"), N.evidence()("context").alias("evidence"))
    return M.faithfulness(rows, ["conv_id", "turn"], "claims", "evidence").drop("unsupported")


@query("e01_f11_bert_score")
def bert_score(t):
    rows = _turns(t)
    return M.bert_score(rows, ["conv_id", "turn"], "answer", "prompt")


EVENT_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"$ref": "#/$defs/small"}}, "additionalProperties": False, "$defs": {"small": {"type": "integer", "minimum": 0, "maximum": 5}}}


@query("f22_compiled_schema", """
SELECT event_id, CASE WHEN props IS NULL OR NOT json_valid(props) THEN NULL WHEN json_type(props) <> 'OBJECT' THEN 1
  ELSE len(list_filter(json_keys(props), lambda x: x <> 'k')) + CASE WHEN NOT list_contains(json_keys(props), 'k') THEN 1
    WHEN json_type(props, '$.k') NOT IN ('BIGINT', 'UBIGINT') THEN 1 ELSE CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) NOT BETWEEN 0 AND 5 AS INTEGER) END END AS errors FROM events""")
def compiled_schema(t):
    return t.events.select("event_id", S.violations(EVENT_SCHEMA, F.col("props")).cast("long").alias("errors"))


@query("s12_s14_run_cases", """
SELECT conv_id + 1 AS case_number, 'case-' || lpad(CAST(conv_id + 1 AS VARCHAR), CAST(greatest(4, length(CAST(conv_id + 1 AS VARCHAR))) AS INTEGER), '0') || '.json' AS file,
       sha256('{"case_number":' || (conv_id + 1) || ',"turns":' || count(*) || '}') AS sha256
FROM conversations WHERE conv_id >= 20 GROUP BY conv_id""")
def run_cases(t):
    """Conversations written as a run and read by number; files of the first twenty are never opened."""
    folder = scratch(t.spark, "run")
    number = (F.col("conv_id") + 1).cast("int")
    cases = t.conversations.groupBy(number.alias("case_number")).agg(F.count("*").alias("turns"))
    payload = F.to_json(F.struct("case_number", "turns"))
    K.write_run(cases.select("case_number", payload.alias("payload")), folder, {"table": "conversations"})
    return K.read_run(t.spark, folder).where("case_number > 20").select(F.col("case_number").cast("long").alias("case_number"), "file", "sha256")


@query("s13_content_cache", """
SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, 1 AS misses, 2 AS hits FROM documents GROUP BY source""")
def content_cache(t):
    """One computation and two readings of the same result, whatever the order of the input's rows."""
    cache = K.Cache(t.spark, scratch(t.spark, "cache"))
    docs = t.documents.select("doc_id", "source", "n_chars")
    totals = lambda d: d.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars"))
    for same in (docs, docs.repartition(3), docs.orderBy(F.desc("doc_id"))):
        found = cache.get("totals", {"by": "source"}, [same], totals)
    return found.select("source", "n", "chars", F.lit(cache.misses).alias("misses"), F.lit(cache.hits).alias("hits"))


@query("n08_s17_sealed_records", """
SELECT o_orderkey, sha256('{"buyer":{"id":' || o_custkey || ',"marks":["' || array_to_string(list_sort([o_orderstatus, o_orderpriority]), '","') || '"]},"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","o_orderkey":' || o_orderkey || ',"price":' || CAST(o_totalprice AS DOUBLE) || '}') AS record_sha256, true AS holds FROM orders""")
def sealed_records(t):
    """Nested records with the digest of their own canonical JSON, checked by computing it again."""
    marks = F.array("o_orderstatus", "o_orderpriority")
    rows = t.orders.select("o_orderkey", F.struct(marks.alias("marks"), F.col("o_custkey").alias("id")).alias("buyer"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("double").alias("price"))
    kept = sealed(rows, sets=["buyer.marks"])
    return kept.select("o_orderkey", "record_sha256", seal_holds(kept, sets=["buyer.marks"]).alias("holds"))


def _drafts(t):
    """(cases, facts): answers as drafts; the sentences of prompt and answer as facts of two fields."""
    cases = _turns(t).select(F.concat_ws("-", "conv_id", "turn").alias("case"), "prompt", "answer")

    def sentences(column, field):
        return F.transform(E.answer_claims(F.col(column)), lambda v, i: F.struct(F.lit(field).alias("field"), i.cast("string").alias("index"), v.alias("value")))

    listed = [sentences("prompt", "objeto"), sentences("answer", "normas_citadas")]
    facts = cases.select("case", F.inline(F.concat(*listed)))
    return cases, facts.withColumn("critical", F.col("field") == "objeto")


@query("e07_legal_gate")
def legal_gate(t):
    cases, facts = _drafts(t)
    return L.legal_gate(cases, facts, "case", "prompt", "answer", noise=["poder ejecutivo"])


@query("e08_factual_fidelity")
def factual_fidelity(t):
    cases, facts = _drafts(t)
    return L.factual_fidelity(cases, facts, "case", "prompt", "answer", noise=["poder ejecutivo"])


@query("e16_e12_run_inventory", """
WITH m AS (SELECT o_orderkey AS c, o_orderstatus AS d FROM orders WHERE o_orderkey % 11 <> 0),
p AS (SELECT l_linenumber AS run, l_orderkey AS c, count(*) AS copies, count(*) FILTER (l_quantity > 10) AS passed, list(DISTINCT l_linestatus) AS ds FROM lineitem GROUP BY ALL),
s AS (SELECT run, count(*) FILTER (m.c IS NOT NULL) AS present, count(*) FILTER (m.c IS NULL) AS unexpected, count(*) FILTER (copies > 1) AS duplicates,
  count(*) FILTER (m.c IS NOT NULL AND len(list_filter(ds, lambda x: x <> m.d)) > 0) AS mismatched, count(*) FILTER (passed = 0) AS failed, count(*) FILTER (passed > 0) AS passed FROM p LEFT JOIN m ON m.c = p.c GROUP BY run),
r AS (SELECT run, n AS reported_total, CASE WHEN run % 2 = 0 THEN ok ELSE ok - 1 END AS reported_passed FROM (SELECT l_linenumber AS run, count(DISTINCT l_orderkey) AS n, count(DISTINCT CASE WHEN l_quantity > 10 THEN l_orderkey END) AS ok FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1)),
j AS (SELECT s.*, (SELECT count(*) FROM m) AS expected, r.reported_total, r.reported_passed FROM s LEFT JOIN r USING (run))
SELECT run, expected, present, expected - present AS missing, unexpected, duplicates, mismatched, failed, passed, reported_total, reported_passed,
  CASE WHEN unexpected + mismatched + duplicates > 0 THEN 'INVALID' WHEN expected > present THEN 'PARTIAL' ELSE 'FULL' END AS integrity,
  concat_ws(',', CASE WHEN unexpected > 0 THEN 'UNEXPECTED_CASES=' || unexpected END, CASE WHEN mismatched > 0 THEN 'DIGEST_MISMATCH=' || mismatched END, CASE WHEN duplicates > 0 THEN 'DUPLICATE_CASES=' || duplicates END,
    CASE WHEN reported_passed <> passed THEN 'REPORT_DISAGREES=' || abs(reported_passed - passed) END, CASE WHEN expected > present THEN 'MISSING_CASES=' || (expected - present) END,
    CASE WHEN failed > 0 THEN 'FAILED_CASES=' || failed END, CASE WHEN reported_total IS NULL THEN 'NOT_REPORTED=1' END) AS findings FROM j""")
def run_inventory(t):
    """Runs (line numbers) against the manifest of orders and their own reports."""
    cases = t.lineitem.select(F.col("l_linenumber").alias("run"), F.col("l_orderkey").alias("case"), F.col("l_linestatus").alias("digest"), (F.col("l_quantity") > 10).alias("passed"))
    manifest = t.orders.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("case"), F.col("o_orderstatus").alias("digest"))
    counted = cases.where("run <> 3").groupBy("run").agg(F.count_distinct("case").alias("total"), F.count_distinct(F.when(F.col("passed"), F.col("case"))).alias("ok"))
    reported = counted.select("run", "total", F.when(F.col("run") % 2 == 0, F.col("ok")).otherwise(F.col("ok") - 1).alias("passed"))
    rows = I.run_inventory(cases, manifest, reported)
    said = F.array_join(F.transform("findings", lambda f: F.concat(f["code"], F.lit("="), f["n"].cast("string"))), ",")
    return rows.drop("worst").withColumn("findings", said)


@query("s15_checked_manifest", """
WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), n AS (SELECT h, count(*) AS n FROM d GROUP BY h)
SELECT 'case-' || doc_id AS case_id, CASE WHEN n > 1 THEN 'CASE_INVALID' WHEN doc_id % 17 = 1 THEN 'PATH_INVALID' WHEN doc_id % 13 = 2 THEN 'FILE_MISSING' WHEN doc_id % 7 = 3 THEN 'HASH_MISMATCH' ELSE 'OK' END AS code FROM d JOIN n USING (h)""")
def checked_manifest(t):
    """A manifest of all documents against what is stored; some paths climb, some files are gone or changed."""
    k = F.col("doc_id")
    name = F.concat(F.when(k % 17 == 1, "../").otherwise("cases/"), k.cast("string"), F.lit(".txt"))
    digest = F.sha2("text", 256)
    cases = t.documents.select(F.concat(F.lit("case-"), k.cast("string")).alias("case_id"), name.alias("relative_path"), digest.alias("sha256"), k.cast("string").alias("external_id"), F.expr("cast(array() as array<string>)").alias("expected"))
    files = t.documents.where("doc_id % 13 <> 2").select(name.alias("path"), F.when(k % 7 == 3, F.reverse(digest)).otherwise(digest).alias("sha256"))
    header = {"split": "HELD_OUT", "dataset_version": "1", "source": "documents"}
    return I.checked_manifest(header, cases, files, "HELD_OUT").select("case_id", "code")


@query("s03_merged_documents", """
SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'CORPUS_JSON_SCHEMA_INVALID' WHEN doc_id % 7 = 2 THEN 'CORPUS_SOURCE_IDENTIFIER_INVALID' WHEN trim(text, ' ') = '' THEN 'CORPUS_JSON_SCHEMA_INVALID' END AS error,
       CASE WHEN doc_id % 5 <> 1 AND doc_id % 7 <> 2 AND trim(text, ' ') <> '' THEN sha256(text) END AS digest, CASE WHEN doc_id % 5 <> 1 AND doc_id % 7 <> 2 AND trim(text, ' ') <> '' THEN '"d' || doc_id || '"' END AS external_id FROM documents""")
def merged_documents(t):
    """Documents as JSON; some name themselves otherwise in their metadata, some by a path that climbs."""
    k = F.col("doc_id").cast("string")
    inner = F.struct(F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("other-"), k)).when(F.col("doc_id") % 5 == 0, F.concat(F.lit("d"), k)).alias("external_id"), F.col("lang").alias("lang"))
    path = F.concat(F.when(F.col("doc_id") % 7 == 2, "../").otherwise("a//"), k)
    text = F.to_json(F.struct(F.col("text").alias("content"), inner.alias("metadata"), F.concat(F.lit("d"), k).alias("external_id"), path.alias("source_identifier")))
    rows = t.documents.select("doc_id", I.merged_document(text, files.safe_identifier).alias("m"))
    return rows.select("doc_id", "m.error", F.sha2("m.content", 256).alias("digest"), F.try_element_at("m.metadata", F.lit("external_id")).alias("external_id"))


@query("j17_aged_orphans", """
WITH f AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'tmp-' ELSE 'f-' END || o_orderkey AS path, o_orderdate AS day FROM orders WHERE o_orderkey % 3 <> 0),
k AS (SELECT DISTINCT 'f-' || l_orderkey AS path FROM lineitem WHERE l_linenumber = 2), n AS (SELECT max(o_orderdate) AS now FROM orders)
SELECT path, CASE WHEN day + INTERVAL 365 DAY > now THEN 'RECENT' WHEN path LIKE 'tmp-%' THEN 'TEMPORARY' ELSE 'ORPHAN' END AS finding FROM f, n WHERE path NOT IN (SELECT path FROM k)
UNION ALL SELECT path, 'MISSING' FROM k WHERE path NOT IN (SELECT path FROM f)""")
def aged_orphans(t):
    k = F.col("o_orderkey").cast("string")
    found = t.orders.where("o_orderkey % 3 <> 0").select(F.concat(F.when(F.col("o_orderkey") % 7 == 0, "tmp-").otherwise("f-"), k).alias("path"), F.col("o_orderdate").cast("timestamp").alias("at"))
    known = t.lineitem.where("l_linenumber = 2").select(F.concat(F.lit("f-"), F.col("l_orderkey").cast("string")).alias("path")).distinct()
    now = F.lit(t.orders.agg(F.max(F.col("o_orderdate").cast("timestamp"))).first()[0])
    return I.aged_orphans(found, known, "path", "at", now, F.expr("interval 365 days"))


@query("n09_identity_forms", r"""
WITH d AS (SELECT doc_id, regexp_extract(text, '[0-9]{2}[- ]?[0-9]{8}[- ]?[0-9]') AS tax, regexp_extract(text, '\+[0-9][0-9 ()-]+[0-9]') AS ph, regexp_extract(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+') AS mail, regexp_extract(text, '[A-Z]{0,2}[0-9]{6,9}') AS num FROM documents)
SELECT doc_id, CASE WHEN tax <> '' THEN replace(replace(tax, '-', ''), ' ', '') END AS tax, replace(ph, ' ', '') AS phone, lower(mail) AS mail,
       CASE WHEN num = '' THEN NULL WHEN doc_id % 2 = 0 AND NOT regexp_matches(num, '^[0-9]+$') THEN NULL ELSE num END AS number FROM d""")
def identity_forms(t):
    """The first identifier of each kind in a text, normalised."""
    first = lambda p: F.regexp_extract("text", p, 0)
    kind = F.when(F.col("doc_id") % 2 == 0, "DNI").otherwise("PASSPORT")
    return t.documents.select(
        "doc_id", ID.tax_number(first(r"[0-9]{2}[- ]?[0-9]{8}[- ]?[0-9]")).alias("tax"), ID.phone(first(r"\+[0-9][0-9 ()-]+[0-9]")).alias("phone"),
        ID.email(first(r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+")).alias("mail"), ID.document_number(kind, first("[A-Z]{0,2}[0-9]{6,9}")).alias("number"),
    )


@query("e02_entities")
def entities(t):
    """The entities of an answer against those of its prompt, as sets."""
    keys = lambda c: F.array_distinct(F.transform(T.entities(F.col(c)), lambda x: x["key"]))
    rows = _turns(t).select("conv_id", "turn", keys("prompt").alias("gold"), keys("answer").alias("found"))
    s = E.set_scores(F.col("found"), F.col("gold"))
    return rows.select("conv_id", "turn", *(s[c].alias(c) for c in s), E.status(s["f1"], F.size("gold") > 0).alias("status"))


@query("e06_structure_report", """
WITH c AS (SELECT event_type, json_valid(props) AS ok, CASE WHEN json_valid(props) THEN props END AS p FROM events),
k AS (SELECT event_type, ok, p, CASE WHEN ok THEN json_type(p, '$.k') END AS kind, CASE WHEN ok THEN json_extract_string(p, '$.k') END AS v FROM c)
SELECT event_type, count(*) AS n, round(avg(CAST(coalesce(ok, false) AS DOUBLE)), 9) AS parse_rate,
  round(avg(CAST(coalesce(kind IN ('BIGINT', 'UBIGINT') AND len(json_keys(p)) = 1 AND TRY_CAST(v AS BIGINT) BETWEEN 0 AND 5, false) AS DOUBLE)), 9) AS valid_rate,
  round(avg(CAST(coalesce(trim(v) <> '', false) AS DOUBLE)), 9) AS completeness FROM k GROUP BY event_type""")
def structure_report(t):
    """How many outputs parse, fit the compiled schema and fill the paths they must."""
    wrong = S.violations(EVENT_SCHEMA, F.col("props"))
    rows = t.events.select("event_type", E.json_kind(F.col("props")).isNotNull().alias("ok"), F.coalesce(wrong == 0, F.lit(False)).alias("fits"), E.required_paths(F.col("props"), ["$.k"]).alias("filled"))
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 9)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), rate("ok").alias("parse_rate"), rate("fits").alias("valid_rate"), rate("filled").alias("completeness"))


@query("e15_case_report")
def case_report(t):
    """All measures of each case beside each other; what can't be computed stays null with its status."""
    cases, facts = _drafts(t)
    key = F.concat_ws("-", "conv_id", "turn").alias("case")
    gate = L.legal_gate(cases, facts, "case", "prompt", "answer").select("case", "legal_pass", F.col("recall").alias("atomic_recall"), "unsupported")
    fidelity = L.factual_fidelity(cases, facts, "case", "prompt", "answer").select(F.col("case").alias("_f"), "fidelity", F.col("f1").alias("material_f1"))
    rows = _contexts(t).select("conv_id", "turn", E.answer_claims(F.col("answer")).alias("claims"), N.evidence()("context").alias("evidence"))
    faith = M.faithfulness(rows, ["conv_id", "turn"], "claims", "evidence").select(key.alias("_g"), "faithfulness", "groundedness", F.col("status").alias("faithfulness_status"))
    near = M.bert_score(_turns(t), ["conv_id", "turn"], "answer", "prompt").select(key.alias("_b"), F.col("f1").alias("bert_f1"), F.col("status").alias("bert_status"))
    met = gate.join(fidelity, F.col("case") == F.col("_f"), "left").join(faith, F.col("case") == F.col("_g"), "left").join(near, F.col("case") == F.col("_b"), "left")
    return met.drop("_f", "_g", "_b")
