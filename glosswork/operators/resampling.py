"""Bootstrap resampling of groups of any size.

A resample of N cases is a multinomial count over the group's distinct values.
It is drawn from the top: a group's values are dealt over cells of bounded size,
a resample's N cases are split over the cells by binomials down a binary tree of
the cells' weights, and each cell draws its part over its own values. That is
the same law as one draw over all values. Every split is seeded by its place in
the tree, so each cell finds its totals alone, from the weights on its way down
(one number a level), and no task holds more than a cell. The cells' sums are
then added by resample.

Rows with a null value take no part. Sums over several cells may differ in the
last bit from run to run, as sums of doubles do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values that a cell holds, about.
CELL = 1 << 14
#: Numbers drawn at a time.
BLOCK = 1 << 22


def _kinds(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def _same(keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return on


def _group_keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"_g_{k}") for k in keys]


def _sized(rows: DataFrame, keys: Sequence[str], values: Sequence[str], cell: int) -> DataFrame:
    """keys, values, _n of the distinct values with the group's _total, _mean_i, _levels and each value's _cell."""
    counts = rows.dropna(subset=list(values)).groupBy(*keys, *values).agg(F.count("*").alias("_n"))
    means = [(F.sum(F.col(v).cast("double") * F.col("_n")) / F.sum("_n")).alias(f"_mean_{i}") for i, v in enumerate(values)]
    levels = F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / F.lit(cell)))).cast("int")
    sizes = counts.groupBy(*_group_keys(keys)).agg(F.sum("_n").alias("_total"), levels.alias("_levels"), *means)
    met = counts.join(sizes, _same(keys))
    place = F.pmod(F.xxhash64(*values), F.expr("shiftleft(1L, _levels)"))
    return met.select(*keys, *values, "_n", "_total", "_levels", *(f"_mean_{i}" for i in range(len(values))), place.alias("_cell"))


def _ways(sized: DataFrame, keys: Sequence[str]) -> DataFrame:
    """_g_keys, _c (cell) and way: from the top level down, the weight of the left child and of both."""
    cells = sized.where("_levels > 0").groupBy(*_group_keys(keys), F.col("_cell").alias("_c"), "_levels").agg(F.sum("_n").alias("_w"))
    marks = [f"_g_{k}" for k in keys]
    steps = cells.select(*marks, "_c", "_w", F.explode(F.sequence(F.lit(1), F.col("_levels"))).alias("_level"), "_levels")
    node = F.expr("shiftright(_c, _levels - _level)")
    steps = steps.withColumn("_node", node).withColumn("_up", F.shiftright("_node", 1))
    splits = steps.groupBy(*marks, "_level", "_up").agg(F.sum(F.when(F.col("_node") % 2 == 0, F.col("_w")).otherwise(0)).alias("_left"), F.sum("_w").alias("_both"))
    other = splits.select(*(F.col(m).alias(f"_s{m}") for m in marks), F.col("_level").alias("_l"), F.col("_up").alias("_u"), "_left", "_both")
    on = (F.col("_level") == F.col("_l")) & (F.col("_up") == F.col("_u"))
    for m in marks:
        on = on & F.col(m).eqNullSafe(F.col(f"_s{m}"))
    met = steps.join(other, on)
    return met.groupBy(*marks, "_c").agg(F.sort_array(F.collect_list(F.struct("_level", "_left", "_both"))).alias("_way"))


def cell_totals(total: int, resamples: int, cell: int, levels: int, way, seed: Sequence[int]):
    """Cases of each resample that fall into a cell; way: (level, left, both) from the top."""
    import numpy as np

    held = np.full(resamples, total, np.int64)
    for level, left, both in way:
        up = cell >> (levels - level + 1)
        lefts = np.random.default_rng([*seed, level, up]).binomial(held, left / both)
        held = held - lefts if cell >> (levels - level) & 1 else lefts
    return held


def sums_of(values, counts, held, seed: Sequence[int], block: int = BLOCK):
    """Sums of the values that each resample draws in a cell, a row a resample;
    block numbers are drawn at a time, which doesn't bear on the result."""
    import numpy as np

    rng, share = np.random.default_rng(list(seed)), counts / counts.sum()
    step = max(1, block // len(counts))
    return np.concatenate([rng.multinomial(held[at : at + step], share) @ values for at in range(0, len(held), step)])


def resampled(rows: DataFrame, keys: Sequence[str], values: Sequence[str], resamples: int, seed: int, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(keys, _b, _s_0, _s_1, ...: sums of each value in resample _b;
    the distinct values of _sized())."""
    sized = _sized(rows, keys, values, cell)
    ways = _ways(sized, keys)
    met = sized.join(ways, _same(keys) & (F.col("_cell") == F.col("_c")), "left")
    ident = F.pmod(F.xxhash64(F.lit(0), *keys), F.lit(1 << 62))
    met = met.select(*keys, *(F.col(v).cast("double").alias(f"_v_{i}") for i, v in enumerate(values)), "_n", "_total", "_levels", "_cell", "_way", ident.alias("_id"))
    width = len(values)

    def draw(frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values([f"_v_{i}" for i in range(width)])
        first = frame.iloc[0]
        way = [] if first["_way"] is None else [(r["_level"], r["_left"], r["_both"]) for r in first["_way"]]
        place = [seed, int(first["_id"])]
        held = cell_totals(int(first["_total"]), resamples, int(first["_cell"]), int(first["_levels"]), way, place)
        sums = sums_of(frame[[f"_v_{i}" for i in range(width)]].to_numpy(float), frame["_n"].to_numpy(np.int64), held, [*place, 0, 0, int(first["_cell"])])
        return pd.DataFrame({k: [first[k]] * resamples for k in keys} | {"_b": range(resamples)} | {f"_s_{i}": sums[:, i] for i in range(width)})

    names = [f"_s_{i}" for i in range(width)]
    drawn = met.groupBy(*keys, "_cell").applyInPandas(draw, f"{_kinds(rows, keys)}, _b int, {', '.join(f'{n} double' for n in names)}")
    return drawn.groupBy(*keys, "_b").agg(*(F.sum(n).alias(n) for n in names)), sized


def _finished(drawn: DataFrame, sizes: DataFrame, keys: Sequence[str], finish, schema: str) -> DataFrame:
    """finish(first row of the group, means by resample) for every group; a group has one row a resample here."""
    met = drawn.join(sizes, _same(keys))

    def last(frame):
        import pandas as pd

        frame, first = frame.sort_values("_b"), frame.iloc[0]
        names = [c for c in frame.columns if c.startswith("_s_")]
        found = finish(first, frame[names].to_numpy(float) / float(first["_total"]))
        return pd.DataFrame({k: [first[k]] * len(next(iter(found.values()))) for k in keys} | found)

    return met.groupBy(*keys).applyInPandas(last, schema)


def _sizes(sized: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    means = [c for c in sized.columns if c.startswith("_mean_")]
    return sized.groupBy(*_group_keys(keys)).agg(F.max("_total").alias("_total"), *(F.max(m).alias(m) for m in means), *more)


def _p(means, resamples: int, extra: int):
    import numpy as np

    tail = np.minimum((means <= 0).sum(axis=0), (means >= 0).sum(axis=0))
    return np.minimum(1.0, 2 * (tail + extra) / (resamples + extra))


def bootstrap(deltas: DataFrame, keys: Sequence[str], value: str, resamples: int = 2000, seed: int = 20260825, plus_one: bool = False, quantiles: str = "linear", cell: int = CELL) -> DataFrame:
    """keys, mean, low, high, p: percentile bootstrap of the mean of paired cases.

    quantiles is NumPy's method: "linear", or "lower" for the truncated position.
    """
    drawn, sized = resampled(deltas, keys, [value], resamples, seed, cell)

    def finish(first, means):
        import numpy as np

        low, high = np.quantile(means[:, 0], [0.025, 0.975], method=quantiles)
        return {"mean": [first["_mean_0"]], "low": [float(low)], "high": [float(high)], "p": [float(_p(means[:, 0], resamples, int(plus_one)))]}

    return _finished(drawn, _sizes(sized, keys), keys, finish, f"{_kinds(deltas, keys)}, mean double, low double, high double, p double")


def bootstrap_bca(rows: DataFrame, keys: Sequence[str], value: str, resamples: int = 2000, seed: int = 20260825, level: float = 0.95, cell: int = CELL) -> DataFrame:
    """keys, n, mean, low, high, method, fallback: bias-corrected and accelerated interval of the mean.

    The jackknife of a mean is known from sums of powers. Where the correction
    isn't defined (one value, or all equal), the percentile interval stands,
    method is "percentile" and fallback says why.
    """
    drawn, sized = resampled(rows, keys, [value], resamples, seed, cell)
    apart = F.col(value).cast("double") - F.col("_mean_0")
    powers = [F.sum(F.col("_n") * apart**i).alias(f"_power_{i}") for i in (2, 3)]

    def places(first, means):
        from statistics import NormalDist

        normal, size, tail = NormalDist(), int(first["_total"]), (1 - level) / 2
        if size < 2 or first["_power_2"] <= 0:
            return None
        # Sums of (value - mean) / (size - 1), squared and cubed.
        skew = float(first["_power_3"]) / 6 / float(first["_power_2"]) ** 1.5
        edge = 1 / (2 * (resamples + 1))
        below = float((means < first["_mean_0"]).mean() + (means == first["_mean_0"]).mean() / 2)
        shift = normal.inv_cdf(min(1 - edge, max(edge, below)))
        found = []
        for raw in (tail, 1 - tail):
            moved = shift + normal.inv_cdf(raw)
            if skew * moved == 1:
                return None
            found.append(normal.cdf(shift + moved / (1 - skew * moved)))
        return found if found[0] <= found[1] else None

    def finish(first, means):
        import numpy as np

        at = places(first, means[:, 0])
        low, high = np.quantile(means[:, 0], at or [(1 - level) / 2, (1 + level) / 2])
        return {
            "n": [int(first["_total"])], "mean": [first["_mean_0"]], "low": [float(low)], "high": [float(high)],
            "method": ["bca" if at else "percentile"], "fallback": [None if at else "DEGENERATE_SAMPLE"],
        }

    return _finished(drawn, _sizes(sized, keys, *powers), keys, finish, f"{_kinds(rows, keys)}, n long, mean double, low double, high double, method string, fallback string")


def bootstrap_shared(deltas: DataFrame, keys: Sequence[str], metrics: Sequence[str], resamples: int = 2000, seed: int = 20260825, cell: int = CELL) -> DataFrame:
    """keys, metric, n, mean, low, high, p: the metrics of a case are drawn together.

    A case without one of the metrics takes no part.
    """
    drawn, sized = resampled(deltas, keys, metrics, resamples, seed, cell)

    def finish(first, means):
        import numpy as np

        low, high = np.quantile(means, [0.025, 0.975], axis=0)
        return {"metric": list(metrics), "n": [int(first["_total"])] * len(metrics), "mean": [first[f"_mean_{i}"] for i in range(len(metrics))], "low": low, "high": high, "p": _p(means, resamples, 0)}

    return _finished(drawn, _sizes(sized, keys), keys, finish, f"{_kinds(deltas, keys)}, metric string, n long, mean double, low double, high double, p double")
