"""Paired inference, intervals, percentiles, ranks, resampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.operators.ranks import running_counts

#: Normal quantile at 97.5 % (a fixed value).
Z = 1.959963984540054


# --- percentiles: four definitions of the p-quantile of an ordered sample ---


def percentile_rounded(values: Column, p: float) -> Column:
    """Element at round-half-even((n - 1) p) of a sorted array."""
    return F.element_at(values, (F.bround((F.size(values) - 1) * F.lit(p), 0) + 1).cast("int"))


def percentile_linear(column: str, p: float) -> Column:
    return F.percentile(column, p)


def percentile_nearest(values: Column, p: float) -> Column:
    """Element at max(1, ceil(p n))."""
    return F.element_at(values, F.greatest(F.lit(1), F.ceil(F.lit(p) * F.size(values))).cast("int"))


def percentile_truncated(values: Column, p: float) -> Column:
    """Element at floor(p (n - 1))."""
    return F.element_at(values, (F.floor(F.lit(p) * (F.size(values) - 1)) + 1).cast("int"))


def rank_percentiles(df: DataFrame, group: str, value: str, ps: Sequence[float]) -> DataFrame:
    """group, p, and the rounded, nearest and truncated percentiles at any size.

    Values are counted first, so a group sends one row per distinct value; the
    wanted positions are then found by running counts over those.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    totals = counts.groupBy(F.col(group).alias("_group")).agg(F.sum("_c").alias("_n"))
    run = running_counts(counts, group, value, "_c", "_hi").join(totals, F.col(group).eqNullSafe(F.col("_group")))
    wanted = F.array(
        *(
            F.struct(F.lit(p).alias("p"), F.lit(name).alias("kind"), place.cast("long").alias("at"))
            for p in ps
            for name, place in (
                ("rounded", F.bround((F.col("_n") - 1) * F.lit(p), 0) + 1),
                ("nearest", F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_n")))),
                ("truncated", F.floor(F.lit(p) * (F.col("_n") - 1)) + 1),
            )
        )
    )
    hit = run.select(group, value, "_hi", "_c", F.explode(wanted).alias("x")).where((F.col("x.at") <= F.col("_hi")) & (F.col("x.at") > F.col("_hi") - F.col("_c")))
    return hit.groupBy(group, F.col("x.p").alias("p")).agg(*(F.max(F.when(F.col("x.kind") == k, F.col(value))).alias(k) for k in ("rounded", "nearest", "truncated")))


# --- intervals and effect sizes ---


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    p = F.try_divide(hits.cast("double"), n.cast("double"))
    z2 = Z * Z
    base = 1 + z2 / n
    mid = (p + z2 / (2 * n)) / base
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / base
    safe = n > 0
    return F.when(safe, F.greatest(mid - half, F.lit(0.0))), F.when(safe, F.least(mid + half, F.lit(1.0)))


def normal_interval(column: str, population: bool = True) -> tuple[Column, Column]:
    """Mean +- z sd / sqrt(n) as aggregates."""
    sd = F.stddev_pop(column) if population else F.stddev_samp(column)
    z = Z if population else 1.96
    half = z * sd / F.sqrt(F.count(column))
    return F.avg(column) - half, F.avg(column) + half


def effect_size(column: str, population: bool = False) -> Column:
    """Mean over sd, null where sd is 0 (sample sd: Cohen's d_z)."""
    sd = F.stddev_pop(column) if population else F.stddev_samp(column)
    return F.when(sd != 0, F.avg(column) / sd)


# --- pairs of runs ---


def run_pairs(cases: DataFrame, run: str, case: str, value: str) -> DataFrame:
    """run_a, run_b, case, a, b for run_a < run_b; one row per (run, case) is expected."""
    a = cases.select(F.col(run).alias("run_a"), F.col(case).alias("case"), F.col(value).alias("a"))
    b = cases.select(F.col(run).alias("run_b"), F.col(case).alias("case"), F.col(value).alias("b"))
    return a.join(b, "case").where("run_a < run_b")


def pair_alignment(left: DataFrame, right: DataFrame, case: str) -> DataFrame:
    """Counts of cases on both sides, left alone, right alone."""
    a = left.select(F.col(case).alias("_a")).distinct()
    b = right.select(F.col(case).alias("_b")).distinct()
    joined = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    return joined.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("paired"), F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"))


def mcnemar_counts(pairs: DataFrame) -> DataFrame:
    """run_a, run_b, n, b (a alone passes), c (b alone passes) of boolean values a, b."""
    return pairs.groupBy("run_a", "run_b").agg(F.count("*").alias("n"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"))


def sign_tail(k: int, n: int) -> float:
    """min(1, 2 P(X <= k)) for X binomial (n, 1/2), in log space."""
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def sign_p(low: Column, n: Column) -> Column:
    """sign_tail() as a column; the table of log factorials never leaves the row."""
    from pyspark.sql.functions import pandas_udf

    def log_choose(n, i):
        return math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)

    def one(k, n):
        logs = [log_choose(n, i) - n * math.log(2) for i in range(k + 1)]
        top = max(logs)
        return min(1.0, 2 * math.exp(top) * math.fsum(math.exp(x - top) for x in logs)) if n else 1.0

    @pandas_udf("double")
    def tail(k, m):
        import pandas as pd

        return pd.Series([one(int(a), int(b)) for a, b in zip(k, m, strict=True)], dtype="float64")

    return tail(low, n)


def mcnemar(pairs: DataFrame) -> DataFrame:
    """mcnemar_counts() with the exact two-sided p."""
    counts = mcnemar_counts(pairs)
    return counts.withColumn("p", sign_p(F.least("only_a", "only_b"), F.col("only_a") + F.col("only_b")))


def holm(df: DataFrame, family: Sequence[str], p: str, order: Sequence[str]) -> DataFrame:
    """Adds p_holm: the running maximum of min(1, (m - k) p) in order of p."""
    by = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    ordered = by.orderBy(p, *order)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(by) - F.row_number().over(ordered) + 1) * F.col(p))
    return df.withColumn("_s", step).withColumn("p_holm", F.max("_s").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def kappa(pairs: DataFrame) -> DataFrame:
    """run_a, run_b, kappa (null where chance agreement is 1) of boolean a, b."""
    n = F.count("*")
    po = F.count_if(F.col("a") == F.col("b")) / n
    pa, pb = F.count_if("a") / n, F.count_if("b") / n
    pe = pa * pb + (1 - pa) * (1 - pb)
    return pairs.groupBy("run_a", "run_b").agg(F.when(pe != 1, (po - pe) / (1 - pe)).alias("kappa"))


def average_ranks(df: DataFrame, column: str, name: str, group: str | None = None) -> DataFrame:
    """Adds 1-based ranks with ties averaged.

    Only distinct values and their counts are ranked; the ranks are joined back.
    """
    keys = [group, column] if group else [column]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_c"))
    upto = running_counts(counts, group, column, "_c", "_upto")
    ranks = upto.select(*(F.col(k).alias(f"_{k}") for k in keys), (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    return df.join(ranks, on).drop(*(f"_{k}" for k in keys))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_ranks(average_ranks(df.select(x, y).where(f"{x} is not null and {y} is not null"), x, "rx"), y, "ry")
    return ranked.agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def signed_rank_p(full_ties: bool = True, exact_to: int = 20):
    """A function (n, w_plus, ties) -> two-sided p of signed ranks.

    Up to exact_to untied differences the rank sums of all sign patterns are
    counted by a table; beyond, the normal form with a continuity of one half and
    the whole or half tie correction.
    """

    def exact(n, low):
        ways = [1] + [0] * (n * (n + 1) // 2)
        for rank in range(1, n + 1):
            for at in range(len(ways) - 1, rank - 1, -1):
                ways[at] += ways[at - rank]
        return min(1.0, 2 * sum(ways[: int(low) + 1]) / 2**n)

    def p(n, plus, ties):
        total = n * (n + 1) / 2
        if n and n <= exact_to and not ties:
            return exact(n, min(plus, total - plus))
        variance = (n * (n + 1) * (2 * n + 1) - ties * (1.0 if full_ties else 0.5)) / 24
        off = abs(plus - total / 2)
        if variance <= 0 or not off:
            return 1.0
        return math.erfc(abs(off - 0.5) / math.sqrt(2 * variance))

    return p


def _signed_ranks(pairs: DataFrame) -> DataFrame:
    """run_a, run_b, n, plus, ties of a - b.

    Signed differences are counted per pair first: a pair's group holds its
    distinct differences, and ranks come from running counts over them, so the
    tests need sums alone.
    """
    d = pairs.select("run_a", "run_b", (F.col("a") - F.col("b")).alias("d")).where("d <> 0")
    size = d.groupBy(F.struct("run_a", "run_b").alias("pair"), F.abs("d").cast("double").alias("size"))
    counts = size.agg(F.count_if(F.col("d") > 0).alias("up"), F.count("*").alias("c"))
    ranked = running_counts(counts, "pair", "size", "c", "upto").withColumn("r", F.col("upto") - (F.col("c") - 1) / 2)
    c = F.col("c").cast("double")
    sums = ranked.groupBy("pair").agg(F.sum("c").alias("n"), F.sum(F.col("up") * F.col("r")).alias("plus"), F.sum(c * c * c - c).alias("ties"))
    return sums.select("pair.run_a", "pair.run_b", "n", "plus", "ties")


def wilcoxon_by_pair(pairs: DataFrame, full_ties: bool = False) -> DataFrame:
    """run_a, run_b, n, w, z (normal form without continuity) of a - b."""
    n = F.col("n").cast("double")
    total = n * (n + 1) / 2
    variance = (n * (n + 1) * (2 * n + 1) - F.col("ties") * (1.0 if full_ties else 0.5)) / 24
    low = F.least("plus", total - F.col("plus"))
    z = F.abs(low - total / 2) / F.sqrt(variance)
    return _signed_ranks(pairs).select("run_a", "run_b", "n", low.alias("w"), z.alias("z"))


def wilcoxon_tests(pairs: DataFrame, exact_to: int = 20) -> DataFrame:
    """run_a, run_b, n, w_plus, w_minus, p_exact, p_half_ties, method of a - b.

    p_exact is exact for few untied differences, else normal with whole ties;
    p_half_ties is always normal. A pair without a difference has n = 0 and p = 1.
    """
    from pyspark.sql.functions import pandas_udf

    whole, half = signed_rank_p(True, exact_to), signed_rank_p(False, 0)

    def column(rule):
        @pandas_udf("double")
        def p(n, plus, ties):
            import pandas as pd

            return pd.Series([rule(int(a), b, c) for a, b, c in zip(n, plus, ties, strict=True)], dtype="float64")

        return p

    every = pairs.groupBy(F.col("run_a").alias("_a"), F.col("run_b").alias("_b")).agg(F.count("*").alias("_n"))
    on = F.col("run_a").eqNullSafe(F.col("_a")) & F.col("run_b").eqNullSafe(F.col("_b"))
    joined = every.join(_signed_ranks(pairs), on, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    rows = joined.select(F.col("_a").alias("run_a"), F.col("_b").alias("run_b"), zero("n").cast("long").alias("n"), zero("plus").alias("w_plus"), zero("ties").alias("ties"))
    method = F.when(F.col("n") == 0, "NO_DIFFERENCE").when((F.col("n") <= exact_to) & (F.col("ties") == 0), "EXACT").otherwise("NORMAL")
    minus = F.col("n") * (F.col("n") + 1) / 2 - F.col("w_plus")
    ps = [column(rule)("n", "w_plus", "ties").alias(name) for rule, name in ((whole, "p_exact"), (half, "p_half_ties"))]
    return rows.select("run_a", "run_b", "n", "w_plus", minus.alias("w_minus"), *ps, method.alias("method"))
