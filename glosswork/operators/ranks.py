"""Positions of rows in an order without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_position(df: DataFrame, group: str | None, order: str, name: str, buckets: int = 256) -> DataFrame:
    """Adds the 0-based position of a row within its group by a unique numeric key.

    The running count of running_counts, each row counting one: rows are numbered
    between quantiles of the key, however sparse or skewed it is, and the buckets'
    totals, at most buckets + 1 a group, are summed up before each.
    """
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return running_counts(ones, group, order, "_one", name, buckets).withColumn(name, F.col(name) - 1).drop("_one")


def global_position(df: DataFrame, order: str, name: str, buckets: int = 256) -> DataFrame:
    return group_position(df, None, order, name, buckets)


def running_counts(counts: DataFrame, group: str | None, value: str, count: str, name: str, buckets: int = 64) -> DataFrame:
    """Adds the running sum of count over a numeric value's order, this row included, within the group.

    Approximate quantiles cut a group's values into buckets, the sum runs inside
    each bucket, and the buckets' totals, at most buckets + 1 a group, are summed
    up before each. The cuts only set the buckets' sizes; the sums are exact.
    """
    rows = counts.withColumn("_g", F.col(group) if group else F.lit(0))
    points = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    cuts = rows.groupBy(F.col("_g").alias("_k")).agg(F.percentile_approx(value, points, F.lit(1000)).alias("_cuts"))
    bucket = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    rows = rows.join(cuts, F.col("_g").eqNullSafe(F.col("_k"))).withColumn("_b", bucket).drop("_cuts", "_k")
    inner = F.sum(count).over(Window.partitionBy("_g", "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    totals = rows.groupBy(F.col("_g").alias("_k"), F.col("_b").alias("_l")).agg(F.sum(count).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_l").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("_k", "_l", before.alias("_before"))
    joined = rows.withColumn("_inner", inner).join(base, F.col("_g").eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_l")))
    return joined.withColumn(name, F.col("_before") + F.col("_inner")).drop("_g", "_b", "_inner", "_k", "_l", "_before")
