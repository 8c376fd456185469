"""Rows that no other row dominates, in any number of objectives.

Each task drops what a row of its own dominates; what is left meets in fewer and
fewer tasks of bounded size while that drops enough. When few rows are left one
task decides. Where many are (objectives that work against each other), blocks
of them meet in pairs and a row stays that no block dominates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.session import written

#: Distinct vectors that one task compares.
BLOCK = 20_000


def undominated(rows, by=None):
    """Mask of the rows (distinct vectors) that no row of by dominates; by: rows themselves by default.

    The greatest row in lexicographic order is dominated by none, so each step
    keeps one row and drops what it dominates.
    """
    import numpy as np

    keep = np.zeros(len(rows), bool)
    if by is None:
        left = np.lexsort(rows.T[::-1])[::-1]
        while len(left):
            best = rows[left[0]]
            keep[left[0]] = True
            left = left[1:][~(best >= rows[left[1:]]).all(axis=1)]
        return keep
    left = np.arange(len(rows))
    for best in by:
        left = left[~((best >= rows[left]).all(axis=1) & (best > rows[left]).any(axis=1))]
    keep[left] = True
    return keep


def _local(vectors: DataFrame) -> DataFrame:
    """The vectors that no vector of their partition dominates."""
    names = vectors.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = np.empty((0, len(names)))
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)])
            held = held[undominated(held)]
        for at in range(0, len(held), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(held[at : at + 10_000, i]) for i in range(len(names))], names=names)

    return vectors.mapInArrow(run, ", ".join(f"{n} double" for n in names))


def _by_blocks(vectors: DataFrame, blocks: int) -> DataFrame:
    """Every block meets every other; the vectors that all of them leave."""
    names = vectors.columns
    own = vectors.withColumn("_own", F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = own.select(*names, F.col("_own").alias("_a"), every.alias("_b"), F.lit(True).alias("_asked"))
    others = own.select(*names, every.alias("_a"), F.col("_own").alias("_b"), F.lit(False).alias("_asked"))

    def meet(frame):
        rows, side = frame[names].to_numpy(float), frame["_asked"].to_numpy(bool)
        return frame.loc[side, names][undominated(rows[side], rows[~side])]

    kinds = ", ".join(f"{n} double" for n in names)
    stays = asked.unionByName(others).groupBy("_a", "_b").applyInPandas(meet, kinds)
    return stays.groupBy(*names).agg(F.count("*").alias("_c")).where(F.col("_c") == blocks).select(*names)


def skyline(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """The undominated rows of a table of distinct vectors of doubles."""
    left = written(_local(vectors), "skyline")
    count = left.count()
    while count > block:
        parts = -(-count // block)
        fewer = written(_local(left.repartition(parts)), "skyline")
        before, left, count = count, fewer, fewer.count()
        if count > 0.8 * before:
            return _by_blocks(left, -(-count // block))
    return _local(left.coalesce(1))


def pareto(df: DataFrame, objectives: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Rows of df that no other row dominates (at least as high everywhere, higher somewhere).

    Equal rows stay together. A row with a null or NaN objective is compared with
    none: it stays and dominates nothing. Objectives are compared as doubles.
    """
    marks = [f"_o{i}" for i in range(len(objectives))]
    values = df.select("*", *(F.col(c).cast("double").alias(m) for c, m in zip(objectives, marks, strict=True)))
    whole = F.lit(True)
    for m in marks:
        whole = whole & F.col(m).isNotNull() & ~F.isnan(m)
    vectors = values.where(whole).select(*((F.col(m) + 0.0).alias(m) for m in marks)).distinct()
    best = skyline(vectors, block)
    on = F.lit(True)
    for m in marks:
        on = on & (F.col(f"v.{m}") == F.col(f"b.{m}"))
    found = values.where(whole).alias("v").join(best.alias("b"), on, "left_semi")
    return found.unionByName(values.where(~whole | whole.isNull())).select(*df.columns)
