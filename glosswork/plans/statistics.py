"""Queries of paired statistics; run = l_linenumber, case = l_orderkey."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glosswork.operators import relational as R
from glosswork.operators import resampling as B
from glosswork.operators import statistics as S
from glosswork.operators.skyline import pareto
from glosswork.plans.registry import query

_CASES = """
WITH cases AS (SELECT l_linenumber AS run, l_orderkey AS c, l_discount >= 0.05 AS pass, l_quantity AS v FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_linenumber, l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) = 1),
pairs AS (SELECT a.run AS run_a, b.run AS run_b, a.c, a.pass AS pa, b.pass AS pb, a.v AS va, b.v AS vb FROM cases a JOIN cases b ON a.c = b.c AND a.run < b.run)
"""


def _cases(t):
    line = t.lineitem
    one = R.latest(line, ["l_linenumber", "l_orderkey"], [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")])
    return one.select(F.col("l_linenumber").alias("run"), F.col("l_orderkey").alias("c"), (F.col("l_discount") >= 0.05).alias("passed"), F.col("l_quantity").alias("v"))


def _pairs(t, value):
    return S.run_pairs(_cases(t), "run", "c", value)


def _deltas(t):
    return _pairs(t, "v").select("run_a", "run_b", (F.col("a") - F.col("b")).alias("d"))


@query("t01_t04_percentiles", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
ps(p) AS (VALUES (0.5), (0.95))
SELECT event_type, CAST(p AS DOUBLE) AS p, max(value) FILTER (i = CAST(round_even((n - 1) * p, 0) AS BIGINT) + 1) AS rounded,
       max(value) FILTER (i = greatest(1, CAST(ceil(p * n) AS BIGINT))) AS nearest, max(value) FILTER (i = CAST(floor(p * (n - 1)) AS BIGINT) + 1) AS truncated
FROM r, ps GROUP BY ALL""")
def percentiles(t):
    return S.rank_percentiles(t.events, "event_type", "value", [0.5, 0.95])


@query("t02_percentile_linear", "SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95 FROM events GROUP BY event_type")
def percentile_linear(t):
    return t.events.groupBy("event_type").agg(F.round(S.percentile_linear("value", 0.5), 9).alias("p50"), F.round(S.percentile_linear("value", 0.95), 9).alias("p95"))


@query("t05_wilson", """
WITH r AS (SELECT lang, CAST(sum(quality) AS DOUBLE) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, n, round(greatest(0, ((k / n) + 3.8414588206941236 / (2 * n) - 1.959963984540054 * sqrt((k / n) * (1 - k / n) / n + 3.8414588206941236 / (4 * n * n))) / (1 + 3.8414588206941236 / n)), 9) AS low,
       round(least(1, ((k / n) + 3.8414588206941236 / (2 * n) + 1.959963984540054 * sqrt((k / n) * (1 - k / n) / n + 3.8414588206941236 / (4 * n * n))) / (1 + 3.8414588206941236 / n)), 9) AS high FROM r""")
def wilson(t):
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return rows.select("lang", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("t06_t07_intervals", """
SELECT event_type, round(avg(value) - 1.959963984540054 * stddev_pop(value) / sqrt(count(value)), 6) AS low_pop, round(avg(value) + 1.959963984540054 * stddev_pop(value) / sqrt(count(value)), 6) AS high_pop,
       round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS low_samp, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS high_samp FROM events GROUP BY event_type""")
def intervals(t):
    a, b = S.normal_interval("value"), S.normal_interval("value", population=False)
    return t.events.groupBy("event_type").agg(*(F.round(c, 6).alias(n) for c, n in zip((*a, *b), ("low_pop", "high_pop", "low_samp", "high_samp"), strict=True)))


@query("j11_run_pairs", _CASES + "SELECT run_a, run_b, count(*) AS n, round(avg(va - vb), 9) AS mean_delta FROM pairs GROUP BY ALL")
def run_pairs(t):
    return _pairs(t, "v").groupBy("run_a", "run_b").agg(F.count("*").alias("n"), F.round(F.avg(F.col("a") - F.col("b")), 9).alias("mean_delta"))


@query("j12_pair_alignment", """
WITH a AS (SELECT DISTINCT l_orderkey AS c FROM lineitem WHERE l_linenumber = 1), b AS (SELECT DISTINCT l_orderkey AS c FROM lineitem WHERE l_linenumber = 5)
SELECT count(*) FILTER (a.c IS NOT NULL AND b.c IS NOT NULL) AS paired, count(*) FILTER (b.c IS NULL) AS left_only, count(*) FILTER (a.c IS NULL) AS right_only FROM a FULL OUTER JOIN b ON a.c = b.c""")
def pair_alignment(t):
    return S.pair_alignment(t.lineitem.where("l_linenumber = 1"), t.lineitem.where("l_linenumber = 5"), "l_orderkey")


@query("t08_mcnemar_counts", _CASES + "SELECT run_a, run_b, count(*) AS n, count(*) FILTER (pa AND NOT pb) AS only_a, count(*) FILTER (NOT pa AND pb) AS only_b FROM pairs GROUP BY ALL")
def mcnemar_counts(t):
    return S.mcnemar_counts(_pairs(t, "passed"))


@query("t08_mcnemar_exact")
def mcnemar_exact(t):
    return S.mcnemar(_pairs(t, "passed"))


@query("t09_sign_test")
def sign_test(t):
    d = _pairs(t, "v").groupBy("run_a", "run_b").agg(F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"))
    return d.withColumn("p", S.sign_p(F.least("wins", "losses"), F.col("wins") + F.col("losses")))


@query("t10_t11_wilcoxon", _CASES + """
, d AS (SELECT run_a, run_b, va - vb AS d FROM pairs WHERE va <> vb),
r AS (SELECT *, rank() OVER (PARTITION BY run_a, run_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY run_a, run_b, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY run_a, run_b, abs(d)) AS c FROM d),
s AS (SELECT run_a, run_b, count(*) AS n, sum(r) FILTER (d > 0) AS plus, sum(c * c - 1.0) AS ties FROM r GROUP BY ALL)
SELECT run_a, run_b, n, CAST(least(plus, n * (n + 1) / 2 - plus) AS DOUBLE) AS w, round(abs(least(plus, n * (n + 1) / 2 - plus) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24), 6) AS z FROM s""")
def wilcoxon(t):
    return S.wilcoxon_by_pair(_pairs(t, "v")).withColumn("z", F.round("z", 6))


@query("t10_t11_wilcoxon_p")
def wilcoxon_p(t):
    return S.wilcoxon_tests(_pairs(t, "v"))


@query("t12_bootstrap_mean")
def bootstrap_mean(t):
    return B.bootstrap_bca(t.lineitem.select("l_returnflag", "l_discount"), ["l_returnflag"], "l_discount")


@query("t13_t14_paired_bootstrap")
def paired_bootstrap(t):
    return B.bootstrap(_deltas(t), ["run_a", "run_b"], "d", plus_one=True)


@query("t14_shared_bootstrap")
def shared_bootstrap(t):
    both = _deltas(t).withColumn("won", F.when(F.col("d") > 0, 1.0).when(F.col("d") < 0, -1.0).otherwise(0.0))
    return B.bootstrap_shared(both, ["run_a", "run_b"], ["d", "won"])


@query("t15_bootstrap_plus_one")
def bootstrap_plus_one(t):
    return B.bootstrap(_deltas(t), ["run_a", "run_b"], "d", resamples=500, plus_one=True, quantiles="lower")


@query("t16_t18_effects", _CASES + """
SELECT run_a, run_b, round(avg(va - vb) / stddev_samp(va - vb), 9) AS d_z, round(avg(va - vb) / stddev_pop(va - vb), 9) AS effect, count(*) FILTER (va > vb) AS wins, count(*) FILTER (va < vb) AS losses, count(*) FILTER (va = vb) AS ties
FROM pairs GROUP BY ALL""")
def effects(t):
    d = _pairs(t, "v").withColumn("d", F.col("a") - F.col("b"))
    return d.groupBy("run_a", "run_b").agg(F.round(S.effect_size("d"), 9).alias("d_z"), F.round(S.effect_size("d", population=True), 9).alias("effect"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"))


_PVALUES = "p AS (SELECT p_brand AS k, p_size % 5 AS family, min(p_retailprice) / 3000.0 AS p FROM part GROUP BY ALL)"


@query("w08_holm", f"""
WITH {_PVALUES}, s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, k) + 1) * p) AS s FROM p)
SELECT family, k, round(p, 9) AS p, round(max(s) OVER (PARTITION BY family ORDER BY p, k ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM s""")
def holm(t):
    p = t.part.groupBy(F.col("p_brand").alias("k"), (F.col("p_size") % 5).alias("family")).agg((F.min("p_retailprice") / 3000.0).alias("p"))
    return S.holm(p, ["family"], "p", ["k"]).select("family", "k", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


@query("t19_t20_tiers")
def tiers(t):
    """Runs not distinguishable from the best after Holm are tier 1."""
    tests = S.holm(S.mcnemar(_pairs(t, "passed")), [], "p", ["run_a", "run_b"])
    rates = _cases(t).groupBy("run").agg(F.avg(F.col("passed").cast("double")).alias("rate"))
    best = rates.agg(F.max(F.struct("rate", (-F.col("run")).alias("m"))).alias("x")).select((-F.col("x.m")).alias("best"))
    joined = rates.join(F.broadcast(best)).join(tests, F.array_sort(F.array("run", "best")) == F.array("run_a", "run_b"), "left")
    return joined.select("run", F.round("rate", 9).alias("rate"), F.when(F.coalesce("p_holm", F.lit(1.0)) >= 0.05, 1).otherwise(2).alias("tier"))


@query("g22_effect_summary", _CASES + """
, d AS (SELECT run_a, run_b, avg(va - vb) AS d FROM pairs GROUP BY ALL)
SELECT run_a, round(median(d), 9) AS med, round(min(d), 9) AS lo, round(max(d), 9) AS hi, count(*) FILTER (abs(d) > 0.1) AS n_large, string_agg(run_a || '-' || run_b, ';' ORDER BY run_b) AS listed FROM d GROUP BY run_a""")
def effect_summary(t):
    d = _pairs(t, "v").groupBy("run_a", "run_b").agg(F.avg(F.col("a") - F.col("b")).alias("d"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list("run_b")), lambda b: F.concat_ws("-", "run_a", b)), ";")
    return d.groupBy("run_a").agg(F.round(F.median("d"), 9).alias("med"), F.round(F.min("d"), 9).alias("lo"), F.round(F.max("d"), 9).alias("hi"), F.count_if(F.abs("d") > 0.1).alias("n_large"), names.alias("listed"))


_BRANDS = "b AS (SELECT p_brand AS run, p_size % 3 AS size, length(p_type) % 3 AS kind, p_partkey % 2 AS par, p_retailprice AS v, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1)"


def _brands(t):
    one = t.part.groupBy(F.col("p_brand").alias("run")).agg(F.min_by(F.struct((F.col("p_size") % 3).alias("size"), (F.length("p_type") % 3).alias("kind"), (F.col("p_partkey") % 2).alias("par"), F.col("p_retailprice").alias("v")), "p_partkey").alias("x"))
    return one.select("run", "x.*")


@query("t21_controlled_contrasts", f"""
WITH {_BRANDS}, c AS (SELECT a.run AS run_a, b.run AS run_b, concat_ws(',', CASE WHEN a.size <> b.size THEN 'size' END, CASE WHEN a.kind <> b.kind THEN 'kind' END, CASE WHEN a.par <> b.par THEN 'par' END) AS changed,
  CAST(a.size <> b.size AS INTEGER) + CAST(a.kind <> b.kind AS INTEGER) + CAST(a.par <> b.par AS INTEGER) AS n, round(a.v - b.v, 6) AS delta FROM b a JOIN b ON a.run < b.run)
SELECT run_a, run_b, changed, delta FROM c WHERE n = 1""")
def controlled_contrasts(t):
    rows = _brands(t)
    a, b = rows.alias("a"), rows.alias("b")
    names = ("size", "kind", "par")
    changed = F.array_compact(F.array(*(F.when(F.col(f"a.{c}") != F.col(f"b.{c}"), F.lit(c)) for c in names)))
    pairs = a.join(F.broadcast(b), F.col("a.run") < F.col("b.run")).select(F.col("a.run").alias("run_a"), F.col("b.run").alias("run_b"), changed.alias("changed"), F.round(F.col("a.v") - F.col("b.v"), 6).alias("delta"))
    return pairs.where(F.size("changed") == 1).withColumn("changed", F.concat_ws(",", "changed"))


@query("f31_changed_parameters", f"""
WITH {_BRANDS} SELECT concat_ws(',', CASE WHEN a.size <> b.size THEN 'size' END, CASE WHEN a.kind <> b.kind THEN 'kind' END, CASE WHEN a.par <> b.par THEN 'par' END) AS changed, count(*) AS n FROM b a JOIN b ON a.run < b.run GROUP BY 1""")
def changed_parameters(t):
    rows = _brands(t)
    a, b = rows.alias("a"), rows.alias("b")
    codes = F.concat_ws(",", *(F.when(F.col(f"a.{c}") != F.col(f"b.{c}"), F.lit(c)) for c in ("size", "kind", "par")))
    return a.join(F.broadcast(b), F.col("a.run") < F.col("b.run")).groupBy(codes.alias("changed")).agg(F.count("*").alias("n"))


@query("t22_scenario_diff", """
WITH a AS (SELECT l_returnflag AS k, round(avg(l_discount), 9) AS m FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS k, round(avg(l_discount), 9) AS m FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.m AS m_a, b.m AS m_b, a.m IS DISTINCT FROM b.m AS differs FROM a FULL OUTER JOIN b ON a.k = b.k""")
def scenario_diff(t):
    mean = lambda df, n: df.groupBy(F.col("l_returnflag").alias(f"k_{n}")).agg(F.round(F.avg("l_discount"), 9).alias(f"m_{n}"))
    a, b = mean(t.lineitem, "a"), mean(t.lineitem.where("l_linestatus = 'F'"), "b")
    return a.join(b, F.col("k_a") == F.col("k_b"), "full_outer").select(F.coalesce("k_a", "k_b").alias("k"), "m_a", "m_b", (~F.col("m_a").eqNullSafe(F.col("m_b"))).alias("differs"))


@query("t23_full_partial_delta", _CASES + """
, f AS (SELECT c, v FROM cases WHERE run = 1), p AS (SELECT c, v FROM cases WHERE run = 6)
SELECT count(*) FILTER (f.c IS NOT NULL AND p.c IS NOT NULL) AS paired, count(*) FILTER (p.c IS NULL) AS excluded, round(avg(f.v - p.v), 9) AS delta FROM f FULL OUTER JOIN p ON f.c = p.c""")
def full_partial_delta(t):
    cases = _cases(t)
    f = cases.where("run = 1").select(F.col("c").alias("cf"), F.col("v").alias("vf"))
    p = cases.where("run = 6").select(F.col("c").alias("cp"), F.col("v").alias("vp"))
    j = f.join(p, F.col("cf") == F.col("cp"), "full_outer")
    return j.agg(F.count_if(F.col("cf").isNotNull() & F.col("cp").isNotNull()).alias("paired"), F.count_if(F.col("cp").isNull()).alias("excluded"), F.round(F.avg(F.col("vf") - F.col("vp")), 9).alias("delta"))


@query("t24_rates_wilson_delta", _CASES + """
SELECT run_a, run_b, round(100 * (avg(CAST(pa AS INTEGER)) - avg(CAST(pb AS INTEGER))), 6) AS delta_pp, round(avg(CAST(pa AS INTEGER)), 9) AS rate_a, round(avg(CAST(pb AS INTEGER)), 9) AS rate_b FROM pairs GROUP BY ALL""")
def rates_delta(t):
    a, b = F.avg(F.col("a").cast("int")), F.avg(F.col("b").cast("int"))
    return _pairs(t, "passed").groupBy("run_a", "run_b").agg(F.round(100 * (a - b), 6).alias("delta_pp"), F.round(a, 9).alias("rate_a"), F.round(b, 9).alias("rate_b"))


@query("t25_best_vs_others", _CASES + """
, best AS (SELECT run FROM cases GROUP BY run ORDER BY avg(v) DESC, run LIMIT 1)
SELECT o.run, count(*) AS n, round(avg(b.v - o.v), 9) AS mean_delta, round(1.96 * stddev_samp(b.v - o.v) / sqrt(count(*)), 9) AS half FROM cases b JOIN cases o ON b.c = o.c AND b.run <> o.run WHERE b.run = (SELECT run FROM best) GROUP BY o.run""")
def best_vs_others(t):
    cases = _cases(t)
    best = cases.groupBy("run").agg(F.avg("v").alias("m")).agg(F.max(F.struct("m", (-F.col("run")).alias("r"))).alias("x")).select((-F.col("x.r")).alias("best"))
    top = cases.join(F.broadcast(best), F.col("run") == F.col("best")).select("c", F.col("v").alias("bv"), "best")
    d = cases.join(top, "c").where("run <> best").withColumn("d", F.col("bv") - F.col("v"))
    return d.groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg("d"), 9).alias("mean_delta"), F.round(1.96 * F.stddev_samp("d") / F.sqrt(F.count("*")), 9).alias("half"))


@query("g12_run_summary", """
WITH r AS (SELECT l_linenumber AS run, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS tp, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F') AS fp, count(*) FILTER (l_returnflag = 'A') AS fn, round(avg(l_discount), 9) AS macro,
  round(quantile_cont(l_discount, 0.1), 9) AS p10, round(quantile_cont(l_discount, 0.9), 9) AS p90 FROM lineitem GROUP BY 1)
SELECT run, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, macro, p10, p90 FROM r""")
def run_summary(t):
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    r = t.lineitem.groupBy(F.col("l_linenumber").alias("run")).agg(
        F.count_if((flag == "R") & (line == "F")).alias("tp"), F.count_if((flag == "R") & (line != "F")).alias("fp"), F.count_if(flag == "A").alias("fn"), F.round(F.avg("l_discount"), 9).alias("macro"), F.percentile("l_discount", F.array(F.lit(0.1), F.lit(0.9))).alias("q")
    )
    tp = F.col("tp").cast("double")
    return r.select("run", F.round(F.try_divide(tp, F.col("tp") + F.col("fp")), 9).alias("precision"), F.round(F.try_divide(tp, F.col("tp") + F.col("fn")), 9).alias("recall"), F.round(F.try_divide(2 * tp, 2 * F.col("tp") + F.col("fp") + F.col("fn")), 9).alias("f1"), "macro", F.round(F.col("q")[0], 9).alias("p10"), F.round(F.col("q")[1], 9).alias("p90"))


@query("g16_long_stats", """
SELECT l_returnflag AS run, metric, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS med, round(stddev_pop(value), 6) AS sd, min(value) AS lo, max(value) AS hi
FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME metric VALUE value) GROUP BY ALL""")
def long_stats(t):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    long = t.lineitem.unpivot(["l_returnflag"], cols, "metric", "value")
    return long.groupBy(F.col("l_returnflag").alias("run"), "metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("med"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("g25_kappa", _CASES + """
, k AS (SELECT run_a, run_b, avg(CAST(pa = pb AS INTEGER)) AS po, avg(CAST(pa AS INTEGER)) AS a, avg(CAST(pb AS INTEGER)) AS b FROM pairs GROUP BY ALL)
SELECT run_a, run_b, round((po - (a * b + (1 - a) * (1 - b))) / nullif(1 - (a * b + (1 - a) * (1 - b)), 0), 9) AS kappa FROM k""")
def kappa(t):
    return S.kappa(_pairs(t, "passed")).withColumn("kappa", F.round("kappa", 9))


@query("w07_avg_rank", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS r FROM part")
def avg_rank(t):
    return S.average_ranks(t.part.select("p_partkey", "p_size"), "p_size", "r").select("p_partkey", "r")


@query("g26_spearman", """
WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS y FROM part)
SELECT count(*) AS n, round(corr(x, y), 9) AS rho FROM r""")
def spearman(t):
    return S.spearman(t.part, "p_size", "p_retailprice").withColumn("rho", F.round("rho", 9))


@query("w09_quality_rank", """
WITH q AS (SELECT p_brand, avg(p_retailprice) AS f, count(*) AS n FROM part GROUP BY 1)
SELECT p_brand, CASE WHEN n >= 10 THEN CAST(row_number() OVER (PARTITION BY n >= 10 ORDER BY f DESC, p_brand) AS INTEGER) END AS r FROM q""")
def quality_rank(t):
    q = t.part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("f"), F.count("*").alias("n")).withColumn("ok", F.col("n") >= 10)
    return q.select("p_brand", F.when(F.col("ok"), F.row_number().over(Window.partitionBy("ok").orderBy(F.desc("f"), "p_brand"))).alias("r"))


@query("w17_leave_one_out", """
WITH s AS (SELECT l_linenumber AS run, l_discount AS x, sum(l_discount) OVER (PARTITION BY l_linenumber) AS t, count(*) OVER (PARTITION BY l_linenumber) AS n FROM lineitem)
SELECT run, round(min((t - x) / (n - 1)), 9) AS lo, round(max((t - x) / (n - 1)), 9) AS hi FROM s WHERE n > 1 GROUP BY run""")
def leave_one_out(t):
    # min and max of (sum - x) / (n - 1) need sum, n and the extreme values alone.
    s = t.lineitem.groupBy(F.col("l_linenumber").alias("run")).agg(F.sum("l_discount").alias("t"), F.count("*").alias("n"), F.min("l_discount").alias("a"), F.max("l_discount").alias("b"))
    return s.where("n > 1").select("run", F.round((F.col("t") - F.col("b")) / (F.col("n") - 1), 9).alias("lo"), F.round((F.col("t") - F.col("a")) / (F.col("n") - 1), 9).alias("hi"))


@query("w18_trimmed_mean", """
WITH r AS (SELECT l_linenumber AS run, l_quantity AS x, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_quantity) AS i, count(*) OVER (PARTITION BY l_linenumber) AS n FROM lineitem)
SELECT run, round(avg(x), 9) AS m FROM r WHERE i > floor(n * 0.10) AND i <= n - floor(n * 0.10) GROUP BY run""")
def trimmed_mean(t):
    # Over counts of distinct values: the part of each value that falls between the cuts.
    c = t.lineitem.groupBy(F.col("l_linenumber").alias("run"), F.col("l_quantity").alias("x")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("run")
    r = c.withColumn("hi", F.sum("c").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w)).withColumn("k", F.floor(F.col("n") * 0.10))
    inside = F.greatest(F.lit(0), F.least("hi", F.col("n") - F.col("k")) - F.greatest(F.col("hi") - F.col("c"), F.col("k")))
    return r.withColumn("m", inside).groupBy("run").agg(F.round(F.sum(F.col("x") * F.col("m")) / F.sum("m"), 9).alias("m"))


@query("j19_pareto", """
WITH s AS (SELECT s_nationkey AS k, count(*) AS n, round(avg(s_acctbal), 2) AS b, max(s_acctbal) AS m FROM supplier GROUP BY 1)
SELECT k, n, b, m FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.n >= x.n AND y.b >= x.b AND y.m >= x.m AND (y.n > x.n OR y.b > x.b OR y.m > x.m))""")
def pareto_front(t):
    s = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 2).alias("b"), F.max("s_acctbal").alias("m"))
    return pareto(s, ["n", "b", "m"])


@query("u05_scenario_sets", """
WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A')
SELECT (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS a_only, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS b_only""")
def scenario_sets(t):
    a = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).distinct()
    b = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("k")).distinct()
    left = a.exceptAll(b).agg(F.count("*").alias("a_only"))
    return left.join(F.broadcast(b.exceptAll(a).agg(F.count("*").alias("b_only"))))
