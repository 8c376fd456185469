"""Reconciliation of keyed artefacts: verified joins, parity, classification, findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.operators.relational import latest


def gold_join(cases: DataFrame, gold: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Every case with its gold row by lower-cased keys (the last gold row wins) and reason, null when it joined."""
    low = {k: F.lower(F.col(k).cast("string")) for k in keys}
    one = latest(gold.withColumns({f"_{k}": c for k, c in low.items()}), [f"_{k}" for k in keys], order).drop(*keys).withColumn("_hit", F.lit(True))
    joined = cases.withColumns({f"_{k}": c for k, c in low.items()}).join(one, [f"_{k}" for k in keys], "left")
    return joined.withColumn("reason", F.when(F.col("_hit").isNull(), "gold_join_missing")).drop("_hit", *(f"_{k}" for k in keys))


def verified(joined: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds join_status: VALID when all pairs are equal (nulls too), else INVALID_REFERENCE_JOIN."""
    ok = F.lit(True)
    for a, b in pairs:
        ok = ok & F.col(a).eqNullSafe(F.col(b))
    return joined.withColumn("join_status", F.when(ok, "VALID").otherwise("INVALID_REFERENCE_JOIN"))


def parity(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """key, column, problem (ONLY_LEFT, ONLY_RIGHT, DIFFERS) of two copies, numbers within a relative tolerance."""
    left = a.select(F.col(key).alias("_ka"), *(F.col(c).alias(f"a_{c}") for c in columns))
    right = b.select(F.col(key).alias("_kb"), *(F.col(c).alias(f"b_{c}") for c in columns))
    joined = left.join(right, F.col("_ka") == F.col("_kb"), "full_outer")
    kinds = dict(a.dtypes)

    def differs(c):
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if kinds[c] in ("double", "float"):
            return ~F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y)), x.isNull() & y.isNull())
        return ~x.eqNullSafe(y)

    both = F.col("_ka").isNotNull() & F.col("_kb").isNotNull()
    problems = F.array(
        F.when(F.col("_kb").isNull(), F.struct(F.lit("*").alias("column"), F.lit("ONLY_LEFT").alias("problem"))),
        F.when(F.col("_ka").isNull(), F.struct(F.lit("*").alias("column"), F.lit("ONLY_RIGHT").alias("problem"))),
        *(F.when(both & differs(c), F.struct(F.lit(c).alias("column"), F.lit("DIFFERS").alias("problem"))) for c in columns),
    )
    return joined.select(F.coalesce("_ka", "_kb").alias(key), F.inline(F.array_compact(problems)))


def disagreement(*values: Column) -> Column:
    """Whether the non-null values are more than one."""
    return F.size(F.array_distinct(F.array_compact(F.array(*values)))) > 1


def coverage(expected: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """Counts of covered, missing, unexpected and hash-mismatched keys."""
    a = expected.select(F.col(key).alias("_a"), F.col(digest).alias("_da"))
    b = found.select(F.col(key).alias("_b"), F.col(digest).alias("_db"))
    j = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.agg(F.count_if(both & (F.col("_da") == F.col("_db"))).alias("covered"), F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("unexpected"), F.count_if(both & (F.col("_da") != F.col("_db"))).alias("mismatched"))


def orphans(files: DataFrame, known: DataFrame, path: str) -> DataFrame:
    """Files that nothing names, TEMPORARY or ORPHAN, and named ones that are not there, MISSING."""
    lost = files.join(known, path, "left_anti").select(path, F.when(F.col(path).startswith("tmp-"), "TEMPORARY").otherwise("ORPHAN").alias("finding"))
    return lost.unionByName(known.join(files, path, "left_anti").select(path, F.lit("MISSING").alias("finding")))


def fallback_match(items: DataFrame, catalog: DataFrame, candidates: Sequence[Column], catalog_key: str, value: str) -> DataFrame:
    """Adds matched: value of the first candidate key that the catalog holds; every row stays, repeated ones too.

    One left join for each candidate against the catalog's distinct keys; of
    rows with an equal key the least value counts.
    """
    names = catalog.groupBy(F.col(catalog_key).alias("_k")).agg(F.min(value).alias("_v"))
    rows = items.select(F.struct(*items.columns).alias("_row"), *(c.alias(f"_c{i}") for i, c in enumerate(candidates)))
    for i in range(len(candidates)):
        one = names.select(F.col("_k").alias(f"_k{i}"), F.col("_v").alias(f"_v{i}"))
        rows = rows.join(one, F.col(f"_c{i}") == F.col(f"_k{i}"), "left")
    return rows.select("_row.*", F.coalesce(*(F.col(f"_v{i}") for i in range(len(candidates)))).alias("matched"))


def classify(rules: Sequence[tuple[str, Column]], other: str) -> Column:
    """The first rule that holds."""
    out = F.lit(other)
    for name, test in reversed(list(rules)):
        out = F.when(test, name).otherwise(out)
    return out
