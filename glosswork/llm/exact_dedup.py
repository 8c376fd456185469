"""Exact deduplication by content sort.

The normalised bytes are range-partitioned with sampled splitters, sorted
externally inside each partition, and neighbours are compared in full. A
splitter holds a bounded prefix of the text and its SHA-256, not the text, so
what the driver samples stays small whatever the texts' length. A text whose
group is larger than a partition ought to be is found beforehand by counting
digests (which map tasks pre-aggregate) and its rows are dealt over as many
salts as needed; there are at most 4 x partitions such texts, so the list of
them has a proven bound and is broadcast.

Defined cases: null text counts as empty; empty texts are equal to each other;
of rows that repeat the kept id exactly one stays; null ids sort below all
others, a group with null ids alone keeps one row with keep_id null; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.llm.common import lower_az, shuffle_partitions, table, text_of

PREFIX = 16


def _ranked(docs: DataFrame, keep: str, carry: bool) -> DataFrame:
    """doc_id, keep_id, group_size, text_sha256, kept; with carry also _row, the row of docs.

    With carry the texts travel once, as they are, and are normalised again
    after the shuffle.
    """
    parts = shuffle_partitions(docs.sparkSession)
    best = F.max if keep == "max" else F.min
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    held = F.col("_row") if carry else F.lower(F.lit(None).cast("string")).alias("_row")
    source = docs.select(F.struct(*(docs[c] for c in (docs.columns if carry else ("doc_id", "text")))).alias("_row"))
    keyed = source.select(held, F.col("_row.doc_id").cast("long").alias("doc_id"), lower_az(text).alias("norm"))
    keyed = keyed.withColumn("sha", F.unhex(F.sha2("norm", 256)))

    share = F.greatest(F.lit(64), F.ceil(F.lit(docs.count()) / (4 * parts)))
    hot = (
        keyed.groupBy("sha")
        .agg(F.count("*").alias("hot_size"), best("doc_id").alias("hot_keep"))
        .where(F.col("hot_size") > share)
        .withColumn("salts", F.ceil(F.col("hot_size") / share).cast("int"))
    )
    dealt = (
        keyed.join(F.broadcast(hot), "sha", "left")
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int"))
        .withColumn("prefix", F.substring("norm", 1, PREFIX))
    )
    dealt = (dealt.drop("norm") if carry else dealt).repartitionByRange(parts, "prefix", "sha", "salt")
    if carry:
        dealt = dealt.withColumn("norm", lower_az(text))
    order = F.col("doc_id").desc_nulls_last() if keep == "max" else F.col("doc_id").asc_nulls_last()
    run = Window.partitionBy("prefix", "sha", "salt", "norm").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = dealt.select(
        "doc_id",
        F.coalesce("hot_keep", best("doc_id").over(whole)).alias("keep_id"),
        F.coalesce("hot_size", F.count(F.lit(1)).over(whole)).alias("group_size"),
        F.row_number().over(run).alias("place"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "_row",
    )
    kept = (F.col("place") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return ranked.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "_row")


def content_sort(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "max" keeps the largest identifier of equal texts, "min" the smallest.
    """
    return _ranked(docs, keep, carry=False).drop("_row")


def keep_one(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return _ranked(docs, keep, carry=True).where("kept").select("_row.*")


def query(spark, sf_dir):
    return content_sort(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
