"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join, so a node with very many
links costs partial sums and a join that Spark may split, never one task's
list. The links of a step are written to the shared folder and read again,
which also cuts lineage. The number of steps grows with the logarithm of the
longest path. Links that are stars already take no step, and none is run only to
see that nothing changes: small tables written in vain cost most of such a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import materialize


def _apart(links: DataFrame, least: DataFrame) -> DataFrame:
    """links with the least neighbour of their hi.

    The key of the second side is written so that Spark doesn't take the sums'
    partitioning for the join's: both sides are then dealt for the join alone,
    and a node with very many links is a skewed partition that Spark may split.
    """
    key = F.bitwise_not(F.bitwise_not(F.col("hi"))).alias("_hi")
    return links.join(least.select(key, "least"), F.col("hi") == F.col("_hi"))


def _large(links: DataFrame) -> DataFrame:
    both = links.select("hi", "lo").unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("least"))
    return _apart(both, least).where(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("least").alias("lo"))


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("least"))
    met = _apart(links, least).where(F.col("lo") != F.col("least")).select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    # least is a far smaller table, so its rows join the others before the one exchange of distinct.
    return met.unionByName(least.select("hi", F.col("least").alias("lo"))).where("hi <> lo").distinct()


def _stars(links: DataFrame) -> bool:
    """Whether each hi has one link and is no lo: then every component is a star around its least node."""
    ends = links.select(F.col("hi").alias("node"), F.lit(1).alias("over"), F.lit(0).alias("under"))
    ends = ends.unionByName(links.select(F.col("lo").alias("node"), F.lit(0).alias("over"), F.lit(1).alias("under")))
    met = ends.groupBy("node").agg(F.sum("over").alias("over"), F.max("under").alias("under"))
    return (met.agg(F.max(F.col("over") + F.col("under"))).first()[0] or 0) <= 1


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node that has a link and is not its component's smallest, which is root.

    Goes on until the links are stars; every step before that brings a node
    nearer to its root, so there is an end.
    """
    now = materialize(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")),
        "links",
    )
    while not _stars(now):
        now = materialize(_small(_large(now)), "links")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
