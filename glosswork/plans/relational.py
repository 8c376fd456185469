"""Queries over the keyed tables: filters, joins, aggregates, ranking, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glosswork.operators import relational as R
from glosswork.plans.registry import query


def _long(c):
    return F.col(c).cast("long")


@query("p01_policy_filter", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 100000""")
def policy_filter(t):
    return t.orders.where((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") >= 100000)).select("o_orderkey", "o_custkey")


@query("p02_json_path", """
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS total
FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 5 GROUP BY event_type""")
def json_path(t):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.select("event_type", k.alias("k")).where("k >= 5").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("p03_ilike", """
SELECT c_custkey FROM customer WHERE c_name ILIKE '%9%' OR c_mktsegment ILIKE '%auto%'""")
def ilike(t):
    name = t.customer.where(F.col("c_name").ilike("%9%") | R.ilike_any(["c_mktsegment"], "auto"))
    return name.select("c_custkey")


@query("p04_date_range", """
SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31' AND o_orderstatus = 'F'""")
def date_range(t):
    lo, hi = F.to_timestamp(F.lit("1995-01-01")), F.to_timestamp(F.lit("1996-12-31"))
    return t.orders.where(F.col("o_orderdate").between(lo, hi) & (F.col("o_orderstatus") == "F")).select("o_orderkey")


@query("p05_keys_semi", """
SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR o_orderkey IN (1, 2, 3, 4, 5)""")
def keys_semi(t):
    poor = t.customer.where("c_acctbal < 0").select("c_custkey", F.lit(True).alias("hit"))
    joined = t.orders.join(poor, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.where(F.col("hit") | F.col("o_orderkey").isin(1, 2, 3, 4, 5)).agg(F.count("*").alias("n"))


@query("p06_pairs_semi", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
WHERE (l_partkey, l_suppkey) IN (SELECT p_partkey, s_suppkey FROM part, supplier WHERE p_partkey % 10 = s_suppkey % 10 AND p_size = 1)
GROUP BY ALL""")
def pairs_semi(t):
    parts = t.part.where("p_size = 1").select("p_partkey", (F.col("p_partkey") % 10).alias("m"))
    pairs = parts.join(t.supplier.select("s_suppkey", (F.col("s_suppkey") % 10).alias("m")), "m")
    hit = t.lineitem.join(pairs, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_suppkey") == F.col("s_suppkey")), "left_semi")
    return hit.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("p08_public_projection", """
SELECT doc_id, lang, substr(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), 1, 500) AS excerpt FROM documents""")
def public_projection(t):
    squashed = F.trim(F.regexp_replace("text", "[ \t\n\r]+", " "))
    return t.documents.select("doc_id", "lang", F.substring(squashed, 1, 500).alias("excerpt"))


@query("p09_filter_sanitiser", """
WITH c AS (SELECT c_custkey, trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '_', 'g'), '_') AS code FROM customer)
SELECT c_custkey, code, code IN ('building', 'machinery', 'household') AS allowed FROM c""")
def filter_sanitiser(t):
    code = F.btrim(F.regexp_replace(F.lower("c_mktsegment"), "[^a-z0-9]+", "_"), F.lit("_"))
    return t.customer.select("c_custkey", code.alias("code")).withColumn("allowed", F.col("code").isin("building", "machinery", "household"))


@query("p10_compare_and_set", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'O' THEN 'P' ELSE o_orderstatus END AS status,
       (o_orderkey % 3 = 0 AND o_orderstatus = 'O') AS applied FROM orders""")
def compare_and_set(t):
    fits = (F.col("o_orderkey") % 3 == 0) & (F.col("o_orderstatus") == "O")
    return t.orders.select("o_orderkey", F.when(fits, "P").otherwise(F.col("o_orderstatus")).alias("status"), fits.alias("applied"))


@query("p11_retention", """
WITH a AS (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last_ts, max(ts) OVER () AS now_ts FROM events)
SELECT event_id FROM a WHERE event_type = 'click' AND ts < last_ts AND ts < now_ts - INTERVAL 7 DAY""")
def retention(t):
    now = t.events.agg(F.max("ts").alias("now_ts"))
    last = F.max("ts").over(Window.partitionBy("user_id"))
    rows = t.events.withColumn("last_ts", last).join(F.broadcast(now))
    return rows.where((F.col("event_type") == "click") & (F.col("ts") < F.col("last_ts")) & (F.col("ts") < F.col("now_ts") - F.expr("interval 7 days"))).select("event_id")


@query("p14_nested_projection", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS flag FROM events""")
def nested_projection(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("flag"))


@query("p15_config_canonical", """
SELECT p_partkey, CASE WHEN upper(p_brand) IN ('NOT_RECORDED', 'NONE', 'NULL', '') THEN NULL ELSE TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) END AS brand_no,
       CASE WHEN contains(lower(p_type), 'brass') THEN 'brass' WHEN contains(lower(p_type), 'steel') THEN 'steel' ELSE 'other' END AS family FROM part""")
def config_canonical(t):
    none = F.upper("p_brand").isin("NOT_RECORDED", "NONE", "NULL", "")
    number = F.when(~none, F.regexp_extract("p_brand", "([0-9]+)", 1).try_cast("int"))
    kind = F.lower("p_type")
    family = F.when(kind.contains("brass"), "brass").when(kind.contains("steel"), "steel").otherwise("other")
    return t.part.select("p_partkey", number.alias("brand_no"), family.alias("family"))


@query("p16_age_rule", """
WITH n AS (SELECT max(o_orderdate) AS now_ts FROM orders)
SELECT o_orderkey FROM orders, n
WHERE o_orderdate <= TIMESTAMP '1997-06-30' AND now_ts - o_orderdate >= INTERVAL 300 DAY""")
def age_rule(t):
    now = t.orders.agg(F.max("o_orderdate").alias("now_ts"))
    rows = t.orders.join(F.broadcast(now))
    old = F.col("o_orderdate") <= F.col("now_ts") - F.expr("interval 300 days")
    return rows.where((F.col("o_orderdate") <= F.to_timestamp(F.lit("1997-06-30"))) & old).select("o_orderkey")


@query("j01_inner", """
SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def inner(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


_J02 = """
SELECT c_custkey, count(o_orderkey) AS n_orders, count(o_orderkey) FILTER (o_orderstatus = 'F') AS n_f,
       count(o_orderkey) FILTER (o_orderstatus = 'O') AS n_o, count(o_orderkey) FILTER (o_orderstatus = 'P') AS n_p,
       count(o_orderkey) FILTER (o_totalprice > 200000) AS n_large
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""


def _counts(t):
    # Orders are summed per customer before the join, so no customer's orders meet in one task.
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    sums = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"), F.count_if(s == "F").alias("n_f"), F.count_if(s == "O").alias("n_o"), F.count_if(s == "P").alias("n_p"), F.count_if(p > 200000).alias("n_large")
    )
    names = ["n_orders", "n_f", "n_o", "n_p", "n_large"]
    return t.customer.join(sums, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


query("j02_left_agg", _J02)(_counts)


@query("g01_filtered_counts", """
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o,
       count(*) FILTER (o_totalprice > 200000) AS n_large FROM orders GROUP BY o_orderpriority""")
def filtered_counts(t):
    s = F.col("o_orderstatus")
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(s == "F").alias("n_f"), F.count_if(s == "O").alias("n_o"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"))


@query("g02_classification", f"""
SELECT c_custkey, CASE WHEN n_orders = 0 THEN 'PENDING' WHEN n_p > 0 THEN 'INVALID' ELSE 'ACTIVE' END AS status FROM ({_J02})""")
def classification(t):
    return _counts(t).select("c_custkey", F.when(F.col("n_orders") == 0, "PENDING").when(F.col("n_p") > 0, "INVALID").otherwise("ACTIVE").alias("status"))


@query("g03_snapshot", """
SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS checksum, concat_ws(',', CASE WHEN count(*) FILTER (o_totalprice < 0) > 0 THEN 'NEGATIVE' END,
       CASE WHEN count(*) <> count(DISTINCT o_orderkey) THEN 'DUPLICATE' END, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'PENDING' END) AS violations
FROM orders""")
def snapshot(t):
    dup = F.count("*") != F.count_distinct("o_orderkey")
    codes = F.concat_ws(",", F.when(F.count_if(F.col("o_totalprice") < 0) > 0, "NEGATIVE"), F.when(dup, "DUPLICATE"), F.when(F.count_if(F.col("o_orderstatus") == "P") > 0, "PENDING"))
    return t.orders.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("checksum"), codes.alias("violations"))


@query("g04_count", "SELECT count(*) AS total FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') q")
def count(t):
    return t.orders.where("o_orderstatus = 'F'").select("o_custkey").distinct().agg(F.count("*").alias("total"))


@query("g05_invariants", """
SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1""")
def invariants(t):
    return t.events.groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.count("*").alias("n")).where("kinds > 1")


@query("g06_next_version", """
SELECT c_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def next_version(t):
    top = t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("m"))
    return t.customer.join(top, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", (F.coalesce("m", F.lit(0)) + 1).alias("next_version"))


@query("g07_conditional_count", """
SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') AS n_blocking FROM orders GROUP BY o_custkey""")
def conditional_count(t):
    return t.orders.groupBy("o_custkey").agg(F.count_if((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O")).alias("n_blocking"))


@query("g08_tagged_counters", """
SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS total, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def tagged_counters(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_linenumber").alias("total"), F.count("*").alias("n"))


@query("g09_status_histogram", """
SELECT 'status' AS dim, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def status_histogram(t):
    pairs = t.orders.select(F.explode(F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))).alias("dim", "status"))
    return pairs.groupBy("dim", "status").agg(F.count("*").alias("n"))


@query("g10_mean_coverage", """
SELECT lang, round(avg(quality), 9) AS mean_quality, count(quality) AS n_known, round(count(quality) / count(*), 9) AS coverage
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def mean_coverage(t):
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return rows.groupBy("lang").agg(F.round(F.avg("quality"), 9).alias("mean_quality"), F.count("quality").alias("n_known"), F.round(F.count("quality") / F.count("*"), 9).alias("coverage"))


@query("g11_run_rates", """
SELECT l_linenumber AS run, count(*) AS n, round(avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END), 9) AS pass_rate,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95
FROM lineitem GROUP BY 1""")
def run_rates(t):
    passed = (F.col("l_discount") >= 0.05).cast("double")
    q = F.percentile("l_extendedprice", F.array(F.lit(0.5), F.lit(0.95)))
    rows = t.lineitem.groupBy(F.col("l_linenumber").alias("run")).agg(F.count("*").alias("n"), F.round(F.avg(passed), 9).alias("pass_rate"), q.alias("q"))
    return rows.select("run", "n", "pass_rate", F.round(F.col("q")[0], 6).alias("p50"), F.round(F.col("q")[1], 6).alias("p95"))


@query("g13_micro_macro", """
WITH r AS (SELECT l_linenumber AS run, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS hit, count(*) AS n FROM lineitem GROUP BY 1)
SELECT round(sum(hit) / sum(n), 9) AS micro, round(avg(hit / n), 9) AS macro FROM r""")
def micro_macro(t):
    runs = t.lineitem.groupBy("l_linenumber").agg(F.count_if(F.col("l_returnflag") == "R").alias("hit"), F.count("*").alias("n"))
    return runs.agg(F.round(F.sum("hit") / F.sum("n"), 9).alias("micro"), F.round(F.avg(F.col("hit") / F.col("n")), 9).alias("macro"))


@query("g17_flag_patterns", """
WITH f AS (SELECT lang, quality = 1 AS good, toxic = 1 AS toxic, n_chars > 2000 AS long FROM labels JOIN documents USING (doc_id))
SELECT *, round(n / sum(n) OVER (PARTITION BY lang), 9) AS share FROM (SELECT lang, good, toxic, long, count(*) AS n FROM f GROUP BY ALL)""")
def flag_patterns(t):
    rows = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    flags = rows.select("lang", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"), (F.col("n_chars") > 2000).alias("long"))
    n = flags.groupBy("lang", "good", "toxic", "long").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 9))


@query("g19_class_summary", """
SELECT k.kind, count(e.event_id) AS n, count(DISTINCT e.user_id) AS users
FROM (VALUES ('click'), ('view'), ('purchase'), ('never')) k(kind) LEFT JOIN events e ON e.event_type = k.kind GROUP BY k.kind""")
def class_summary(t):
    kinds = t.spark.createDataFrame([("click",), ("view",), ("purchase",), ("never",)], "kind string")
    sums = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return kinds.join(sums, F.col("kind") == F.col("event_type"), "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("users", F.lit(0)).alias("users"))


@query("g20_replicates", """
SELECT p_brand, p_size, count(*) AS n, count(DISTINCT p_type) AS outputs FROM part GROUP BY ALL HAVING count(DISTINCT p_type) > 1""")
def replicates(t):
    return t.part.groupBy("p_brand", "p_size").agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("outputs")).where("outputs > 1")


@query("g21_duplicates", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicates(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("g23_dry_run_rollup", """
SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 2000) AS n_long, CAST(ceil(count(*) / 16.0) AS BIGINT) AS n_batches FROM documents GROUP BY lang""")
def dry_run_rollup(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 2000).alias("n_long"), F.ceil(F.count("*") / 16).alias("n_batches"))


@query("g27_all_ok", """
SELECT c_mktsegment, CASE WHEN bool_and(c_acctbal > -999) THEN 'OK' ELSE 'PARTIAL' END AS status FROM customer GROUP BY 1""")
def all_ok(t):
    return t.customer.groupBy("c_mktsegment").agg(F.when(F.every(F.col("c_acctbal") > -999), "OK").otherwise("PARTIAL").alias("status"))


@query("g28_wide_cases", """
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey""")
def wide_cases(t):
    wide = t.orders.groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_custkey", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"))


@query("g29_ordered_regroup", """
SELECT o_custkey, list_distinct_in_order AS statuses FROM (
  SELECT o_custkey, array_to_string(list(o_orderpriority ORDER BY first_key), ',') AS list_distinct_in_order
  FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_key FROM orders GROUP BY ALL) GROUP BY o_custkey)""")
def ordered_regroup(t):
    firsts = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first_key"))
    listed = F.array_sort(F.collect_list(F.struct("first_key", "o_orderpriority")))
    return firsts.groupBy("o_custkey").agg(F.array_join(F.transform(listed, lambda x: x["o_orderpriority"]), ",").alias("statuses"))


@query("g30_completeness_gate", """
SELECT l_orderkey, bool_and(l_linestatus = 'F') AS all_done, CAST(sum(l_linenumber) AS BIGINT) = count(*) * (count(*) + 1) // 2 AS gapless FROM lineitem GROUP BY l_orderkey""")
def completeness_gate(t):
    n = F.count("*")
    return t.lineitem.groupBy("l_orderkey").agg(F.every(F.col("l_linestatus") == "F").alias("all_done"), (F.sum("l_linenumber") == F.floor(n * (n + 1) / 2)).alias("gapless"))


@query("g31_exists_per_group", """
SELECT c_custkey, coalesce(bool_or(o_orderstatus = 'O'), false) AS has_open, coalesce(bool_or(o_orderstatus = 'F'), false) AS has_done
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def exists_per_group(t):
    s = F.col("o_orderstatus")
    flags = t.orders.groupBy("o_custkey").agg(F.some(s == "O").alias("a"), F.some(s == "F").alias("b"))
    return t.customer.join(flags, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("a", F.lit(False)).alias("has_open"), F.coalesce("b", F.lit(False)).alias("has_done"))


@query("g32_eligibility", "SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS eligible, count(*) AS n FROM labels")
def eligibility(t):
    return t.labels.agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("eligible"), F.count("*").alias("n"))


@query("g33_catalog_uniqueness", """
SELECT 'id' AS field, CAST(p_partkey AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'name', p_name, count(*) FROM part GROUP BY 2 HAVING count(*) > 1""")
def catalog_uniqueness(t):
    pairs = t.part.select(F.explode(F.create_map(F.lit("id"), F.col("p_partkey").cast("string"), F.lit("name"), F.col("p_name"))).alias("field", "value"))
    return pairs.groupBy("field", "value").agg(F.count("*").alias("n")).where("n > 1")


@query("j03_inner_report", """
SELECT s_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name""")
def inner_report(t):
    sums = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("s"))
    return sums.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_name").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("total"))


@query("j10_self_conflict", """
WITH r AS (SELECT l_partkey, l_suppkey, l_returnflag, min(l_orderkey) AS first_key, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT a.l_partkey, a.l_suppkey, a.l_returnflag AS flag_a, b.l_returnflag AS flag_b, CAST(a.n * b.n AS BIGINT) AS pairs
FROM r a JOIN r b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_returnflag < b.l_returnflag""")
def self_conflict(t):
    # Rows of one value collapse first: a key joins as many rows as it has different values.
    r = t.lineitem.groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    a, b = r.alias("a"), r.alias("b")
    on = (F.col("a.l_partkey") == F.col("b.l_partkey")) & (F.col("a.l_suppkey") == F.col("b.l_suppkey")) & (F.col("a.l_returnflag") < F.col("b.l_returnflag"))
    return a.join(b, on).select("a.l_partkey", "a.l_suppkey", F.col("a.l_returnflag").alias("flag_a"), F.col("b.l_returnflag").alias("flag_b"), (F.col("a.n") * F.col("b.n")).alias("pairs"))


@query("j13_set_diff", """
SELECT c_custkey AS k, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT DISTINCT o_custkey, 'extra' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def set_diff(t):
    return R.set_difference(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), "k")


@query("j15_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("k02_pagination", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
def pagination(t):
    return R.page(t.orders, [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, 20).select("o_orderkey", "o_orderdate")


@query("k03_full_walk", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS page FROM orders")
def full_walk(t):
    # Pages of the whole table: positions come from counts per key range, not from one sorted task.
    from glosswork.operators.ranks import global_position

    return global_position(t.orders.select("o_orderkey"), "o_orderkey", "pos").select("o_orderkey", F.floor(F.col("pos") / 1000).alias("page"))


@query("k04_work_queue", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 16")
def work_queue(t):
    return t.orders.where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").select("o_orderkey").limit(16)


@query("k05_limit_files", "SELECT doc_id FROM documents ORDER BY lower(source), source, doc_id LIMIT 50")
def limit_files(t):
    return t.documents.orderBy(F.lower("source"), "source", "doc_id").select("doc_id").limit(50)


@query("k06_stratified_sample")
def stratified_sample(t):
    return R.stratified_sample(t.documents.select("doc_id", "lang"), "lang", "doc_id", 10, 7)


@query("k06_filled_sample")
def filled_sample(t):
    return R.filled_sample(t.documents.select("doc_id", "source"), "source", "doc_id", 100, 7)


@query("k08_ordered_log", "SELECT event_id, ts, event_type FROM events WHERE user_id = 7 ORDER BY ts, event_id")
def ordered_log(t):
    return t.events.where("user_id = 7").select("event_id", "ts", "event_type").orderBy("ts", "event_id")


@query("k09_pending_batches", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') AND o_orderstatus = 'P' ORDER BY o_orderpriority, o_orderkey""")
def pending_batches(t):
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM") & (F.col("o_orderstatus") == "P")).orderBy("o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority")


@query("w10_latest", """
SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest(t):
    # max_by sums partially before the shuffle; a window would gather a user's events.
    top = t.events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"))
    return top.select("user_id", "x.event_id", "x.event_type")


@query("w11_latest_attempt", """
WITH m AS (SELECT user_id, event_type, max(ts) AS m FROM events GROUP BY ALL)
SELECT event_id FROM events JOIN m USING (user_id, event_type) WHERE ts >= m.m""")
def latest_attempt(t):
    m = t.events.groupBy("user_id", "event_type").agg(F.max("ts").alias("m"))
    return t.events.join(m, ["user_id", "event_type"]).where("ts >= m").select("event_id")


@query("w12_canonical", """
SELECT p_brand, p_size, min_by(p_name, p_partkey) AS canonical FROM part GROUP BY ALL""")
def canonical(t):
    return t.part.groupBy("p_brand", "p_size").agg(F.min_by("p_name", "p_partkey").alias("canonical"))


@query("w13_batches", """
SELECT doc_id, source, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS BIGINT) AS batch_index FROM documents""")
def batches(t):
    from glosswork.operators.ranks import group_position

    return group_position(t.documents.select("doc_id", "source"), "source", "doc_id", "pos").select("doc_id", "source", F.floor(F.col("pos") / 16).alias("batch_index"))


@query("w15_transitions", """
WITH p AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status, event_type AS to_status FROM events)
SELECT from_status, to_status, count(*) AS n FROM p WHERE from_status IS NOT NULL GROUP BY ALL""")
def transitions(t):
    return R.transitions(t.events, "user_id", [F.col("ts"), F.col("event_id")], "event_type")


@query("w15_invalid_steps", """
WITH p AS (SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status, event_type AS to_status FROM events)
SELECT event_id FROM p WHERE from_status IS NOT NULL AND (from_status, to_status) NOT IN (VALUES ('view', 'click'), ('click', 'purchase'), ('view', 'view'))""")
def invalid_steps(t):
    allowed = t.spark.createDataFrame([("view", "click"), ("click", "purchase"), ("view", "view")], "from_status string, to_status string")
    return R.check_transitions(t.events, "user_id", [F.col("ts"), F.col("event_id")], "event_type", allowed).select("event_id")


@query("u01_set_operations", """
WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT 'tp' AS part, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL
SELECT 'fp', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'fn', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def set_operations(t):
    a = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct()
    b = t.supplier.select(F.col("s_nationkey").alias("k")).distinct()
    parts = {"tp": a.intersect(b), "fp": a.subtract(b), "fn": b.subtract(a)}
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("part"), "k")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("u03_disjoint", """
WITH s AS (SELECT o_custkey, array_agg(DISTINCT o_orderstatus) AS a, array_agg(DISTINCT substr(o_orderpriority, 1, 1)) AS b FROM orders GROUP BY 1)
SELECT o_custkey, NOT list_has_any(a, ['P']) AS no_pending, len(list_filter(b, lambda x: x NOT IN ('1', '2', '3'))) = 0 AS only_high FROM s""")
def disjoint(t):
    s = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a"), F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("b"))
    high = F.array(*map(F.lit, "123"))
    return s.select("o_custkey", (~F.arrays_overlap("a", F.array(F.lit("P")))).alias("no_pending"), (F.size(F.array_except("b", high)) == 0).alias("only_high"))


@query("u07_generation_swap", """
WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS chunk, l_suppkey, l_partkey, CAST(l_linenumber % 3 AS INTEGER) AS generation, CASE WHEN l_linenumber % 3 = 1 THEN 'ACTIVE' WHEN l_linenumber % 3 = 2 THEN 'STAGED' ELSE 'SUPERSEDED' END AS state FROM lineitem),
r AS (SELECT *, bool_or(generation = 2 AND state = 'STAGED') OVER (PARTITION BY doc) AS ready FROM c)
SELECT CASE WHEN ready AND generation = 2 AND state = 'STAGED' THEN 'ACTIVE' WHEN ready AND generation <> 2 AND state = 'ACTIVE' THEN 'SUPERSEDED' ELSE state END AS state, generation, count(*) AS n
FROM r GROUP BY ALL""")
def generation_swap(t):
    g = (F.col("l_linenumber") % 3).cast("int")
    chunks = t.lineitem.select(F.col("l_orderkey").alias("doc"), g.alias("generation"), F.when(g == 1, "ACTIVE").when(g == 2, "STAGED").otherwise("SUPERSEDED").alias("state"))
    return R.swap_generation(chunks, "doc", 2).groupBy("state", "generation").agg(F.count("*").alias("n"))


@query("u08_idempotency", """
WITH n AS (SELECT max(ts) AS now_ts FROM events), r AS (
SELECT event_id, ts > now_ts - INTERVAL 1 DAY AS fresh, value > 0 AS same, event_type = 'view' AS processing, event_type = 'purchase' AS done FROM events, n)
SELECT CASE WHEN NOT fresh THEN 'NEW' WHEN NOT same THEN 'MISMATCH' WHEN processing THEN 'IN_PROGRESS' WHEN done THEN 'REPLAY' ELSE 'NEW' END AS outcome, count(*) AS n
FROM r GROUP BY 1""")
def idempotency(t):
    now = t.events.agg(F.max("ts").alias("now_ts"))
    kind = F.col("event_type")
    fresh = F.col("ts") > F.col("now_ts") - F.expr("interval 1 day")
    outcome = R.classify_request(fresh, kind == "view", kind == "purchase", F.col("value") > 0)
    return t.events.join(F.broadcast(now)).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("u09_supersede", """
SELECT o_orderkey, CASE WHEN o_orderkey <> max(o_orderkey) OVER (PARTITION BY o_custkey) AND o_orderstatus = 'F' THEN 'SUPERSEDED' ELSE o_orderstatus END AS status FROM orders""")
def supersede(t):
    top = t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("top"))
    old = (F.col("o_orderkey") != F.col("top")) & (F.col("o_orderstatus") == "F")
    return t.orders.join(top, "o_custkey").select("o_orderkey", F.when(old, "SUPERSEDED").otherwise(F.col("o_orderstatus")).alias("status"))


@query("u10_expired_delete", """
SELECT count(*) AS kept FROM events, (SELECT max(ts) AS m FROM events) WHERE ts >= m - INTERVAL 24 HOUR""")
def expired_delete(t):
    now = t.events.agg(F.max("ts").alias("m"))
    return t.events.join(F.broadcast(now)).where(F.col("ts") >= F.col("m") - F.expr("interval 24 hours")).agg(F.count("*").alias("kept"))


@query("w06_first_occurrence", "SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_key FROM orders GROUP BY ALL")
def first_occurrence(t):
    return t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first_key"))
