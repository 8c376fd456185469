"""Queries that compare, verify and classify keyed artefacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswork.operators import reconcile as C
from glosswork.operators import relational as R
from glosswork.plans.registry import query


@query("j04_gold_join", "SELECT doc_id, quality, CASE WHEN quality IS NULL THEN 'gold_join_missing' END AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def gold_join(t):
    return C.gold_join(t.documents.select("doc_id"), t.labels, ["doc_id"], [F.desc("quality"), F.desc("toxic")]).select("doc_id", "quality", "reason")


@query("j05_expected_range", "SELECT n AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'MISSING' ELSE 'PRESENT' END AS status FROM range(0, (SELECT max(doc_id) + 1 FROM documents)) r(n) LEFT JOIN labels l ON l.doc_id = n")
def expected_range(t):
    """Every number up to the last document's, with or without labels."""
    last = t.documents.agg(F.max("doc_id")).first()[0]
    return R.expected_range(t.labels, "doc_id", 0, -1 if last is None else last)


@query("j06_verified_join", """
SELECT o_orderkey, CASE WHEN c_custkey IS NOT DISTINCT FROM o_custkey AND c_nationkey IS NOT DISTINCT FROM CAST(o_orderkey % 25 AS INTEGER) THEN 'VALID' ELSE 'INVALID_REFERENCE_JOIN' END AS join_status
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def verified_join(t):
    j = t.orders.withColumn("nation", (F.col("o_orderkey") % 25).cast("int")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return C.verified(j, [("c_custkey", "o_custkey"), ("c_nationkey", "nation")]).select("o_orderkey", "join_status")


@query("j14_disagreement", """
WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, count(DISTINCT o_orderdate) AS n FROM orders GROUP BY 1), c AS (SELECT o_custkey AS k, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1)
SELECT a.k AS custkey, NOT (a.n = b.n AND b.n = c.n) AS differs FROM a JOIN b USING (k) JOIN c USING (k)""")
def disagreement(t):
    sums = t.orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("a"), F.count_distinct("o_orderdate").alias("b"), F.count_distinct("o_orderpriority").alias("c"))
    return sums.select("custkey", C.disagreement(F.col("a"), F.col("b"), F.col("c")).alias("differs"))


@query("j17_orphans", """
WITH f AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'tmp-' || c_custkey ELSE 'f-' || c_custkey END AS path FROM customer WHERE c_custkey % 3 <> 0), k AS (SELECT DISTINCT 'f-' || o_custkey AS path FROM orders)
SELECT path, CASE WHEN path LIKE 'tmp-%' THEN 'TEMPORARY' ELSE 'ORPHAN' END AS finding FROM f WHERE path NOT IN (SELECT path FROM k)
UNION ALL SELECT path, 'MISSING' FROM k WHERE path NOT IN (SELECT path FROM f)""")
def orphans(t):
    k = F.col("c_custkey")
    files = t.customer.where(k % 3 != 0).select(F.when(k % 7 == 0, F.concat(F.lit("tmp-"), k)).otherwise(F.concat(F.lit("f-"), k)).alias("path"))
    known = t.orders.select(F.concat(F.lit("f-"), "o_custkey").alias("path")).distinct()
    return C.orphans(files, known, "path")


@query("j20_fallback_match", """
SELECT p_partkey, coalesce(a.n_name, b.n_name, c.n_name) AS matched FROM part LEFT JOIN nation a ON a.n_nationkey = p_size + 20 LEFT JOIN nation b ON b.n_nationkey = p_size LEFT JOIN nation c ON c.n_nationkey = p_size % 25""")
def fallback_match(t):
    s = F.col("p_size")
    return C.fallback_match(t.part.select("p_partkey", "p_size"), t.nation, [s + 20, s, s % 25], "n_nationkey", "n_name").select("p_partkey", "matched")


@query("j21_full_vs_partial", """
WITH f AS (SELECT l_orderkey AS k, max(l_discount) AS m FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), p AS (SELECT l_orderkey AS k, max(l_discount) AS m FROM lineitem WHERE l_linenumber = 4 GROUP BY 1)
SELECT round(avg(f.m), 9) AS full_mean, round(avg(p.m), 9) AS partial_mean, round(avg(f.m) FILTER (p.k IS NOT NULL), 9) AS full_common, round(avg(p.m) FILTER (f.k IS NOT NULL), 9) AS partial_common FROM f FULL OUTER JOIN p ON f.k = p.k""")
def full_vs_partial(t):
    best = lambda n, x: t.lineitem.where(F.col("l_linenumber") == n).groupBy(F.col("l_orderkey").alias(f"k{x}")).agg(F.max("l_discount").alias(x))
    j = best(1, "f").join(best(4, "p"), F.col("kf") == F.col("kp"), "full_outer")
    common = F.col("kf").isNotNull() & F.col("kp").isNotNull()
    return j.agg(F.round(F.avg("f"), 9).alias("full_mean"), F.round(F.avg("p"), 9).alias("partial_mean"), F.round(F.avg(F.when(common, F.col("f"))), 9).alias("full_common"), F.round(F.avg(F.when(common, F.col("p"))), 9).alias("partial_common"))


@query("j22_context_lookup", """
SELECT o_orderkey, coalesce(c_name, '') AS customer, coalesce(n_name, '') AS nation, sha256('{"customer":"' || coalesce(c_name, '') || '","nation":"' || coalesce(n_name, '') || '"}') AS digest, CASE WHEN o_orderstatus = 'P' AND c_custkey IS NULL THEN 'MISSING_CUSTOMER' END AS error
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def context_lookup(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    context = F.struct(F.coalesce("c_name", F.lit("")).alias("customer"), F.coalesce("n_name", F.lit("")).alias("nation"))
    return j.select("o_orderkey", context["customer"].alias("customer"), context["nation"].alias("nation"), F.sha2(F.to_json(context), 256).alias("digest"), F.when((F.col("o_orderstatus") == "P") & F.col("c_custkey").isNull(), "MISSING_CUSTOMER").alias("error"))


@query("j23_strict_check", """
SELECT o_orderkey, concat_ws(',', CASE WHEN c_custkey IS NULL THEN 'customer' END, CASE WHEN NOT starts_with(c_name, 'Customer') THEN 'name' END, CASE WHEN c_nationkey % 2 <> o_orderkey % 2 THEN 'parity' END) AS failed FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def strict_check(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    failed = F.concat_ws(",", F.when(F.col("c_custkey").isNull(), "customer"), F.when(~F.col("c_name").startswith("Customer"), "name"), F.when(F.col("c_nationkey") % 2 != F.col("o_orderkey") % 2, "parity"))
    return j.select("o_orderkey", failed.alias("failed"))


@query("j24_coverage", """
WITH e AS (SELECT doc_id, sha256(text) AS d FROM documents), f AS (SELECT doc_id, sha256(CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END) AS d FROM documents WHERE doc_id % 4 <> 0)
SELECT count(*) FILTER (e.d = f.d) AS covered, count(*) FILTER (f.doc_id IS NULL) AS missing, count(*) FILTER (e.doc_id IS NULL) AS unexpected, count(*) FILTER (e.d <> f.d) AS mismatched FROM e FULL OUTER JOIN f ON e.doc_id = f.doc_id""")
def coverage(t):
    d = t.documents
    found = d.where("doc_id % 4 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("text")), 256).alias("d"))
    return C.coverage(d.select("doc_id", F.sha2("text", 256).alias("d")), found, "doc_id", "d")


@query("j25_run_consistency", """
WITH r AS (SELECT l_linenumber AS run, count(DISTINCT l_orderkey) AS present, count(*) AS n_rows, count(*) FILTER (l_linestatus = 'F') AS done, count(*) FILTER (l_linestatus = 'O') AS open FROM lineitem GROUP BY 1), e AS (SELECT count(*) AS expected FROM orders)
SELECT run, concat_ws(',', CASE WHEN present < expected THEN 'MISSING_CASES' END, CASE WHEN n_rows <> present THEN 'DUPLICATE_CASES' END, CASE WHEN done + open <> n_rows THEN 'STATUS_SUM' END) AS issues FROM r, e""")
def run_consistency(t):
    e = t.orders.agg(F.count("*").alias("expected"))
    r = t.lineitem.groupBy(F.col("l_linenumber").alias("run")).agg(F.count_distinct("l_orderkey").alias("present"), F.count("*").alias("n_rows"), F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count_if(F.col("l_linestatus") == "O").alias("open"))
    issues = F.concat_ws(",", F.when(F.col("present") < F.col("expected"), "MISSING_CASES"), F.when(F.col("n_rows") != F.col("present"), "DUPLICATE_CASES"), F.when(F.col("done") + F.col("open") != F.col("n_rows"), "STATUS_SUM"))
    return r.join(F.broadcast(e)).select("run", issues.alias("issues"))


@query("j26_two_copy_parity", """
SELECT p_partkey, 'ONLY_LEFT' AS problem, '*' AS column FROM part WHERE p_partkey % 50 = 0
UNION ALL SELECT p_partkey, 'DIFFERS', 'p_size' FROM part WHERE p_partkey % 50 <> 0 AND p_partkey % 7 = 0""")
def two_copy_parity(t):
    other = t.part.where("p_partkey % 50 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).withColumn("p_retailprice", F.col("p_retailprice") * (1 + 1e-12))
    return C.parity(t.part, other, "p_partkey", ["p_name", "p_size", "p_retailprice"]).select("p_partkey", "problem", "column")


@query("e11_artefact_classes", """
WITH g AS (SELECT p_brand, p_size, count(*) AS n, count(DISTINCT p_type) AS outs FROM part GROUP BY ALL)
SELECT CASE WHEN n = 1 THEN 'UNIQUE' WHEN outs = 1 THEN 'REPLICATE' WHEN outs = n THEN 'VARIANTS' ELSE 'MIXED' END AS class, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_parts FROM g GROUP BY 1""")
def artefact_classes(t):
    g = t.part.groupBy("p_brand", "p_size").agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("outs"))
    kind = C.classify([("UNIQUE", F.col("n") == 1), ("REPLICATE", F.col("outs") == 1), ("VARIANTS", F.col("outs") == F.col("n"))], "MIXED")
    return g.groupBy(kind.alias("class")).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_parts"))


@query("e12_reconciliation", """
WITH s AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey AS k, CASE WHEN n IS NULL THEN 'WARN' WHEN total < 0 THEN 'BLOCK' WHEN n > 15 THEN 'WARN' ELSE 'OK' END AS finding FROM customer LEFT JOIN s ON k = c_custkey""")
def reconciliation(t):
    s = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))
    j = t.customer.join(s, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select(F.col("c_custkey").alias("k"), C.classify([("WARN", F.col("n").isNull()), ("BLOCK", F.col("total") < 0), ("WARN", F.col("n") > 15)], "OK").alias("finding"))


@query("e13_storage", """
WITH f AS (SELECT 'f-' || c_custkey AS path FROM customer WHERE c_custkey % 3 <> 0), k AS (SELECT DISTINCT 'f-' || o_custkey AS path FROM orders)
SELECT finding, count(*) AS n FROM (SELECT 'ORPHAN' AS finding FROM f WHERE path NOT IN (SELECT path FROM k) UNION ALL SELECT 'MISSING' FROM k WHERE path NOT IN (SELECT path FROM f)) GROUP BY 1""")
def storage(t):
    files = t.customer.where("c_custkey % 3 <> 0").select(F.concat(F.lit("f-"), "c_custkey").alias("path"))
    known = t.orders.select(F.concat(F.lit("f-"), "o_custkey").alias("path")).distinct()
    return C.orphans(files, known, "path").groupBy("finding").agg(F.count("*").alias("n"))


@query("e16_s14_inventory", """
WITH r AS (SELECT l_linenumber AS run, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1), e AS (SELECT count(*) AS e FROM orders)
SELECT run, n, CASE WHEN n = e THEN 'FULL' WHEN n > e THEN 'INVALID' ELSE 'PARTIAL' END AS integrity FROM r, e""")
def inventory(t):
    e = t.orders.agg(F.count("*").alias("e"))
    r = t.lineitem.groupBy(F.col("l_linenumber").alias("run")).agg(F.count_distinct("l_orderkey").alias("n"))
    return r.join(F.broadcast(e)).select("run", "n", C.classify([("FULL", F.col("n") == F.col("e")), ("INVALID", F.col("n") > F.col("e"))], "PARTIAL").alias("integrity"))
