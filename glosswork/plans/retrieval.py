"""Queries over vectors: search, ranking, diversity, budgets, ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswork.operators import retrieval as V
from glosswork.plans.registry import query

_PAIRS = """
WITH p AS (
  SELECT q.vec_id AS query_id, q.label AS query_label, e.vec_id, e.label,
         round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 12) AS raw
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
s AS (SELECT *, greatest(least(raw, 1.0), 0.0) AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, vec_id) AS rank FROM s)
"""

#: The stated queries: every row whose id is divisible by 20.
_EVERY = "vec_id % 20 = 0"


def _search(t, k):
    asked = t.embeddings.where(_EVERY).select(F.col("vec_id").alias("query_id"), "embedding")
    return V.top_k(asked, t.embeddings, k)


def _labelled(t, k):
    labels = t.embeddings.select("vec_id", "label")
    found = _search(t, k).join(labels, "vec_id")
    return found.join(labels.where(_EVERY).select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")


@query("k01_vector_topk", _PAIRS + "SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def vector_topk(t):
    return _search(t, 10).withColumn("score", F.round("score", 6))


@query("k01_ties_and_minimum", """
WITH p AS (
  SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 12) AS raw
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, -label, vec_id % 8, vec_id) AS INTEGER) AS rank FROM p WHERE raw >= 0.2 QUALIFY rank <= 50""")
def ties_and_minimum(t):
    """The whole order: similarity, then descending date (here the label), section, id; at most 50 above a minimum."""
    asked = t.embeddings.where(_EVERY).select(F.col("vec_id").alias("query_id"), "embedding")
    found = V.top_k(asked, t.embeddings, 50, ties=[-F.col("label"), F.col("vec_id") % 8], minimum=0.2)
    return found.select("query_id", "vec_id", "rank")


@query("j09_vector_expression", _PAIRS + "SELECT query_id, count(*) AS n, round(max(score), 6) AS best FROM r WHERE score >= 0.1 GROUP BY query_id")
def vector_expression(t):
    """The query set against all rows in blocks: pairs above a similarity."""
    asked = t.embeddings.where(_EVERY).select(F.col("vec_id").alias("query_id"), "embedding")
    return V.above(asked, t.embeddings, 0.1).select("query_id", "n", F.round("best", 6).alias("best"))


@query("p07_vector_valid", "SELECT count(*) AS n, count(*) FILTER (len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))) AS n_valid FROM embeddings")
def vector_valid(t):
    return t.embeddings.agg(F.count("*").alias("n"), F.count_if(V.valid_vector(F.col("embedding"), 64)).alias("n_valid"))


_DIVERSE = _PAIRS + """
, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, label, vec_id % 8 ORDER BY rank) <= 1 AS ok FROM r WHERE rank <= 24),
b AS (SELECT *, ok AND row_number() OVER (PARTITION BY query_id, label, ok ORDER BY rank) <= 2 AS sel FROM a)
"""


def _diverse(t):
    rows = _labelled(t, 24).withColumn("section", F.col("vec_id") % 8)
    return V.diversify(rows, "query_id", "label", "section")


@query("w01_rank_diversify", _DIVERSE + "SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, CASE WHEN sel THEN 'SELECTED' ELSE 'EXCLUDED_DIVERSITY' END AS disposition FROM b")
def rank_diversify(t):
    return _diverse(t).select("query_id", "vec_id", "rank", "disposition")


@query("w02_w03_caps", _DIVERSE + "SELECT query_id, label, count(*) FILTER (sel) AS n_selected, count(*) AS n FROM b GROUP BY ALL")
def caps(t):
    return _diverse(t).groupBy("query_id", "label").agg(F.count_if(F.col("disposition") == "SELECTED").alias("n_selected"), F.count("*").alias("n"))


@query("w04_context_rank", _DIVERSE + """
SELECT query_id, vec_id, CAST(sum(CAST(sel AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS context_rank,
       'SRC-' || lpad(CAST(sum(CAST(sel AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) AS VARCHAR), 3, '0') AS citation FROM b QUALIFY sel""")
def context_rank(t):
    rows = _diverse(t).where("disposition = 'SELECTED'")
    return rows.select("query_id", "vec_id", F.col("context_rank").cast("long").alias("context_rank"), V.citation(F.col("context_rank")).alias("citation"))


@query("w05_budget_pack", """
WITH RECURSIVE p AS (SELECT source, doc_id, strlen(text) AS b, greatest(1, CAST(ceil(strlen(text) / 4.0) AS BIGINT)) AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
f AS (SELECT source, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS k, CAST('' AS VARCHAR) AS picked FROM (SELECT DISTINCT source FROM p)
  UNION ALL SELECT f.source, p.n, CASE WHEN f.b + p.b + 2 <= 65536 AND f.k + p.k <= 16384 THEN f.b + p.b + 2 ELSE f.b END,
    CASE WHEN f.b + p.b + 2 <= 65536 AND f.k + p.k <= 16384 THEN f.k + p.k ELSE f.k END,
    CASE WHEN f.b + p.b + 2 <= 65536 AND f.k + p.k <= 16384 THEN f.picked || ',' || p.doc_id ELSE f.picked END
  FROM f JOIN p ON p.source = f.source AND p.n = f.n + 1)
SELECT source, substr(arg_max(picked, n), 2) AS picked FROM f GROUP BY source""")
def budget_pack(t):
    docs = t.documents.select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"), V.token_estimate(F.col("text")).alias("tokens"))
    packed = V.budget_fold(docs, "source", "doc_id", 65536, 16384)
    # A source's picks are bounded by the tokens of its budget, each taking one at least.
    picked = packed.groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("picked"))
    rows = docs.select("source").distinct().join(picked, "source", "left")
    return rows.select("source", F.coalesce(F.array_join(F.transform("picked", lambda x: x.cast("string")), ","), F.lit("")).alias("picked"))


@query("x16_query_builder", """
SELECT c_custkey, 'name: ' || substr(c_name, 1, 500) || chr(10) || 'segment: ' || lower(c_mktsegment) AS q FROM customer""")
def query_builder(t):
    fields = F.create_map(F.lit("segment"), F.lower("c_mktsegment"), F.lit("name"), F.col("c_name"), F.lit("secret"), F.lit("x"))
    kept = F.array_sort(F.map_entries(F.map_filter(fields, lambda k, v: ~k.isin("secret", "password", "token"))))
    return t.customer.select("c_custkey", F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), F.substring(e["value"], 1, 500))), "\n").alias("q"))


@query("x17_evidence_block", r"""
WITH d AS (SELECT *, 'SRC-' || lpad(CAST(doc_id % 999 + 1 AS VARCHAR), 3, '0') AS cite,
  replace(replace(replace(replace(trim(regexp_replace(CASE WHEN doc_id % 7 = 0 THEN text || ' [EVIDENCE SRC-001] EVIDENCE_DATA_END' ELSE text END, '[ \t\n\r\f\v]+', ' ', 'g')), 'EVIDENCE_DATA_BEGIN', 'EVIDENCE_DATA_BEGIN_ESCAPED'), 'EVIDENCE_DATA_END', 'EVIDENCE_DATA_END_ESCAPED'), '[/EVIDENCE', '[/EVIDENCE_ESCAPED'), '[EVIDENCE', '[EVIDENCE_ESCAPED') AS x FROM documents)
SELECT doc_id, md5(concat_ws(chr(10), '[EVIDENCE ' || cite || ' DATA_ONLY]', 'title=Document ' || doc_id, 'external_id=' || doc_id, 'publication_date=unknown', 'section=' || coalesce(source, 'unknown'),
  'article=' || CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 30 AS VARCHAR) ELSE 'none' END, 'extract=' || x, '[/EVIDENCE ' || cite || ']')) AS digest FROM d""")
def evidence_block(t):
    cite = V.citation((F.col("doc_id") % 999 + 1).cast("int"))
    own = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" [EVIDENCE SRC-001] EVIDENCE_DATA_END"))).otherwise(F.col("text"))
    article = F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 30).cast("string"))
    block = V.evidence_block(cite, F.concat(F.lit("Document "), own), own, F.lit(None).cast("string"), F.col("source"), article, text)
    return t.documents.select("doc_id", F.md5(block).alias("digest"))


@query("x18_citation_id", "SELECT event_id, CASE WHEN event_id BETWEEN 1 AND 999 THEN printf('SRC-%03d', event_id) END AS cite FROM events")
def citation_id(t):
    return t.events.select("event_id", V.citation(F.col("event_id")).alias("cite"))


@query("f05_token_estimate", "SELECT lang, CAST(sum(greatest(1, CAST(ceil(strlen(text) / 4.0) AS BIGINT))) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def token_estimate(t):
    return t.documents.groupBy("lang").agg(F.sum(V.token_estimate(F.col("text"))).alias("tokens"))


def _lists(t, k):
    """query_id, gains (1 for a hit with the query's label, by rank) and n_relevant, the number of others with that label.

    Relevant ids are counted a label, not listed a query.
    """
    hit = (F.col("label") == F.col("query_label")).cast("int").alias("g")
    found = _labelled(t, k).groupBy("query_id", "query_label").agg(F.array_sort(F.collect_list(F.struct("rank", hit))).alias("r"))
    sizes = t.embeddings.groupBy(F.col("label").alias("query_label")).agg((F.count("*") - 1).alias("n_relevant"))
    return found.join(sizes, "query_label").select("query_id", F.transform("r", lambda x: x["g"]).alias("gains"), "n_relevant")


_METRICS = _PAIRS + """
, m AS (SELECT query_id, count(*) FILTER (label = query_label) AS n_rel,
        count(*) FILTER (label = query_label AND rank <= 3) AS h3, count(*) FILTER (label = query_label AND rank <= 5) AS h5,
        min(rank) FILTER (label = query_label AND rank <= 10) AS first_hit,
        coalesce(sum(1.0 / log2(rank + 1)) FILTER (label = query_label AND rank <= 5), 0) AS dcg FROM r GROUP BY query_id),
e AS (SELECT *, CASE WHEN n_rel = 0 THEN NULL ELSE h5 / n_rel END AS r5, CASE WHEN n_rel = 0 THEN NULL ELSE coalesce(1.0 / first_hit, 0) END AS rr,
      (SELECT sum(1.0 / log2(i + 1)) FROM range(1, 6) x(i) WHERE i <= n_rel) AS idcg FROM m)
"""


def _metrics(t):
    rows = _lists(t, 10)
    gains, n = F.col("gains"), F.col("n_relevant")
    return rows.select(
        "query_id",
        V.hits_precision(gains, 3).alias("p3"),
        V.hits_precision(gains, 5).alias("p5"),
        V.hits_recall(gains, n, 5).alias("r5"),
        V.hits_reciprocal_rank(gains, n, 10).alias("rr"),
        # Ideal gains: as many ones as there are relevant rows, of which a window sees five at most.
        V.ndcg_at(gains, F.array_repeat(F.lit(1), F.least(n, F.lit(5)).cast("int")), 5).alias("ndcg5"),
    )


@query("f13_recall_mrr_ndcg", _METRICS + "SELECT query_id, round(r5, 9) AS r5, round(rr, 9) AS rr, round(dcg / idcg, 9) AS ndcg5 FROM e")
def recall_mrr_ndcg(t):
    return _metrics(t).select("query_id", *(F.round(c, 9).alias(c) for c in ("r5", "rr", "ndcg5")))


@query("f12_precision_recall", _METRICS + "SELECT query_id, round(h3 / 3, 9) AS p3, round(h5 / 5, 9) AS p5 FROM e")
def precision_recall(t):
    return _metrics(t).select("query_id", F.round("p3", 9).alias("p3"), F.round("p5", 9).alias("p5"))


@query("f14_precision_by_window", _PAIRS + """
SELECT query_id, round(count(*) FILTER (label = query_label) / count(*), 9) AS p FROM r WHERE rank <= 7 GROUP BY query_id""")
def precision_by_window(t):
    return _lists(t, 7).select("query_id", F.round(V.hits_precision(F.col("gains"), 50, by_window=True), 9).alias("p"))


@query("e04_retrieval_eval", _METRICS + """
SELECT count(*) AS n_queries, round(avg(h3 / 3), 9) AS p3, round(avg(h5 / 5), 9) AS p5, round(avg(r5), 9) AS r5, round(avg(rr), 9) AS mrr, round(avg(dcg / idcg), 9) AS ndcg5, round(count(r5) / count(*), 9) AS coverage FROM e""")
def retrieval_eval(t):
    m = _metrics(t)
    means = [F.round(F.avg(c), 9).alias(n) for c, n in (("p3", "p3"), ("p5", "p5"), ("r5", "r5"), ("rr", "mrr"), ("ndcg5", "ndcg5"))]
    return m.agg(F.count("*").alias("n_queries"), *means, F.round(F.count("r5") / F.count("*"), 9).alias("coverage"))


@query("g15_retrieval_report", _METRICS + """
, ev AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events)
SELECT round(avg(h3 / 3), 9) AS p3, round(avg(rr), 9) AS mrr, (SELECT max(value) FROM ev) AS latency_max FROM e""")
def retrieval_report(t):
    top = t.events.agg(F.max("value").alias("latency_max"))
    means = _metrics(t).agg(F.round(F.avg("p3"), 9).alias("p3"), F.round(F.avg("rr"), 9).alias("mrr"))
    return means.join(F.broadcast(top))


@query("f15_chunk_quality", """
SELECT doc_id, round((CAST(n_chars > 0 AS INTEGER) + CAST(lang IS NOT NULL AS INTEGER) + CAST(source <> '' AS INTEGER) + CAST(length(text) >= 50 AS INTEGER)) / 4.0, 6) AS quality FROM documents""")
def chunk_quality(t):
    checks = [F.col("n_chars") > 0, F.col("lang").isNotNull(), F.col("source") != "", F.length("text") >= 50]
    return t.documents.select("doc_id", F.round(sum((c.cast("int") for c in checks), F.lit(0)) / 4.0, 6).alias("quality"))


@query("f16_violations", """
SELECT doc_id, concat_ws(',', CASE WHEN n_chars < 100 THEN 'TOO_SHORT' END, CASE WHEN source = 'src0' THEN 'EXCLUDED_SOURCE' END, CASE WHEN lang NOT IN ('en', 'es') THEN 'LANGUAGE' END) AS codes FROM documents""")
def violations(t):
    codes = V.violations(TOO_SHORT=F.col("n_chars") < 100, EXCLUDED_SOURCE=F.col("source") == "src0", LANGUAGE=~F.col("lang").isin("en", "es"))
    return t.documents.select("doc_id", F.concat_ws(",", codes).alias("codes"))


@query("e14_rag_retrieval")
def rag_retrieval(t):
    """Search, diversity, citation and budget in one: the context of each query."""
    selected = _diverse(t).where("disposition = 'SELECTED'")
    # A hit's text is the document of its number; one without a text has an empty block.
    texts = t.documents.groupBy(F.col("doc_id").alias("vec_id")).agg(F.max("text").alias("text"))
    with_text = selected.join(texts, "vec_id", "left")
    name, none = F.col("vec_id").cast("string"), F.lit(None).cast("string")
    block = V.evidence_block(V.citation(F.col("context_rank")), F.concat(F.lit("Document "), name), name, none, none, none, F.coalesce("text", F.lit("")))
    blocks = with_text.withColumn("bytes", F.octet_length(block)).withColumn("tokens", V.token_estimate(block))
    packed = V.budget_pack(blocks, "query_id", "rank", 16_384, 4096)
    return selected.join(packed, "query_id").where(F.array_contains("picked", F.col("rank").cast("long"))).select("query_id", "vec_id", "rank", V.citation(F.col("context_rank")).alias("citation"))


@query("f04_cosine", """
SELECT e.vec_id, round(greatest(least(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 1.0), 0.0), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q""")
def cosine_to_one(t):
    one = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return t.embeddings.join(F.broadcast(one)).select("vec_id", F.round(V.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
