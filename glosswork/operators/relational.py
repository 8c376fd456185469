"""Filters, joins, aggregates, ranking and set operations over keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page number (from 1) of size rows."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def ilike_any(columns: Sequence[str], needle: str) -> Column:
    """Whether any column contains needle, whatever its case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False))
    return found


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side alone, with the side: missing (left only) or extra."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def expected_range(found: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Every number of the range, with status PRESENT or MISSING."""
    numbers = found.sparkSession.range(first, last + 1).withColumnRenamed("id", "_n")
    marked = found.select(F.col(key).alias("_k")).distinct()
    joined = numbers.join(marked, F.col("_n") == F.col("_k"), "left")
    return joined.select(F.col("_n").alias(key), F.when(F.col("_k").isNull(), "MISSING").otherwise("PRESENT").alias("status"))


def batches(df: DataFrame, group: str, order: Sequence[Column], size: int) -> DataFrame:
    """Adds batch_index: rows of a group in order, size to a batch."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("batch_index", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def transitions(log: DataFrame, entity: str, order: Sequence[Column], status: str) -> DataFrame:
    """Counts of consecutive statuses of an entity: from_status, to_status, n."""
    w = Window.partitionBy(entity).orderBy(*order)
    pairs = log.select(F.lag(status).over(w).alias("from_status"), F.col(status).alias("to_status"))
    return pairs.where("from_status is not null").groupBy("from_status", "to_status").agg(F.count("*").alias("n"))


def check_transitions(log: DataFrame, entity: str, order: Sequence[Column], status: str, allowed: DataFrame) -> DataFrame:
    """Steps of the log that allowed (from_status, to_status) does not hold."""
    w = Window.partitionBy(entity).orderBy(*order)
    steps = log.withColumn("from_status", F.lag(status).over(w)).withColumn("to_status", F.col(status)).where("from_status is not null")
    return steps.join(F.broadcast(allowed), ["from_status", "to_status"], "left_anti")


def stratified_sample(df: DataFrame, stratum: str, key: str, size: int, seed: int) -> DataFrame:
    """size rows of each stratum, chosen by a seeded hash of the key."""
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= size).drop("_rn")


def filled_sample(df: DataFrame, stratum: str, key: str, size: int, seed: int) -> DataFrame:
    """size rows in all (fewer only if there are fewer): an equal share, one at
    least, of each stratum; what small strata leave open is filled from all rows.

    No stratum gives more than size rows, which a group limit keeps below the
    exchange; the fill is a top-k, not a sort of the table.
    """
    order = F.xxhash64(F.col(key), F.lit(seed))
    strata = df.select(stratum).distinct().agg(F.greatest(F.lit(1), F.floor(F.try_divide(F.lit(size), F.count("*")))).alias("_share"))
    ranked = stratified_sample(df, stratum, key, size, seed).withColumn("_rn", F.row_number().over(Window.partitionBy(stratum).orderBy(order, F.col(key))))
    marked = ranked.join(F.broadcast(strata)).withColumn("_more", F.col("_rn") > F.col("_share"))
    return marked.orderBy("_more", F.xxhash64(F.col(key), F.lit(seed + 1)), key).limit(size).drop("_rn", "_share", "_more")


def merge_status(stored: DataFrame, incoming: DataFrame, key: Sequence[str], digest: str) -> DataFrame:
    """Incoming rows with outcome CREATED, UNCHANGED or UPDATED against stored ones."""
    held = stored.select(*(F.col(k).alias(f"_{k}") for k in key), F.col(digest).alias("_digest"))
    on = None
    for k in key:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    outcome = F.when(F.col("_digest").isNull(), "CREATED").when(F.col("_digest") == F.col(digest), "UNCHANGED").otherwise("UPDATED")
    return incoming.join(held, on, "left").withColumn("outcome", outcome).drop("_digest", *(f"_{k}" for k in key))


def swap_generation(chunks: DataFrame, key: str, generation: int) -> DataFrame:
    """A new snapshot: staged chunks of the generation become ACTIVE where a
    document has all of them staged, its former active ones SUPERSEDED."""
    w = Window.partitionBy(key)
    ready = F.max(((F.col("generation") == generation) & (F.col("state") == "STAGED")).cast("int")).over(w) == 1
    state = (
        F.when(ready & (F.col("generation") == generation) & (F.col("state") == "STAGED"), "ACTIVE")
        .when(ready & (F.col("generation") != generation) & (F.col("state") == "ACTIVE"), "SUPERSEDED")
        .otherwise(F.col("state"))
    )
    return chunks.withColumn("state", state)


def classify_request(fresh: Column, processing: Column, succeeded: Column, same_hash: Column) -> Column:
    """Outcome of a request against the stored one of its key, tested in order."""
    return (
        F.when(fresh.isNull() | ~fresh, "NEW")
        .when(~same_hash, "MISMATCH")
        .when(processing, "IN_PROGRESS")
        .when(succeeded, "REPLAY")
        .otherwise("NEW")
    )
