"""Split draws have the law of whole ones; skylines equal a loop over all pairs."""

import random

import numpy as np
import pytest

from glosswork.operators import resampling, skyline


def test_split_totals_add_up(spark):
    rows = [("a", float(i)) for i in range(300)] + [("b", 1.0)] * 5 + [(None, 2.0), (None, None)]
    df = spark.createDataFrame(rows, "g string, v double")
    drawn, sized = resampling.resampled(df.selectExpr("g", "v", "1.0 as one"), ["g"], ["v", "one"], 50, 3, cell=8)
    assert sized.where("g = 'a'").select("_cell").distinct().count() > 20
    got = drawn.collect()
    assert len(got) == 150
    size = {"a": 300, "b": 5, None: 1}
    assert all(r._s_1 == size[r.g] for r in got)
    assert {r._s_0 for r in got if r.g == "b"} == {5.0}


@pytest.mark.parametrize("cell", [4, 1 << 14])
def test_law_of_means(spark, cell):
    rng = np.random.default_rng(1)
    values = np.round(rng.gamma(2.0, 1.0, 400), 3)
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    r = resampling.bootstrap_bca(df, ["g"], "v", resamples=6000, cell=cell).first()
    drawn, _ = resampling.resampled(df, ["g"], ["v"], 6000, 9, cell)
    means = np.array([x._s_0 for x in drawn.collect()]) / len(values)
    error = values.std() / len(values) ** 0.5
    assert abs(means.mean() - values.mean()) < 5 * error / 6000**0.5
    assert abs(means.std() / error - 1) < 0.05
    plain = np.sort(rng.choice(values, (6000, len(values))).mean(axis=1))
    assert np.abs(np.sort(means) - plain).mean() < 0.1 * error
    assert r.method == "bca" and r.low < r.mean < r.high
    assert abs((r.high - r.low) / (2 * 1.96 * error) - 1) < 0.1
    # Seeded: the same again.
    again = {x._b: x._s_0 for x in resampling.resampled(df, ["g"], ["v"], 50, 9, cell)[0].collect()}
    twice = {x._b: x._s_0 for x in resampling.resampled(df, ["g"], ["v"], 50, 9, cell)[0].collect()}
    assert again.keys() == twice.keys() and all(abs(again[b] - twice[b]) < 1e-9 for b in again)


def test_cell_totals_are_multinomial():
    """Cells of weights 1, 2, 3, 4 under a tree of two levels: means and covariances."""
    ways = [[(1, 3, 10), (2, 1, 3)], [(1, 3, 10), (2, 1, 3)], [(1, 3, 10), (2, 3, 7)], [(1, 3, 10), (2, 3, 7)]]
    held = np.stack([resampling.cell_totals(10, 40_000, c, 2, way, [5]) for c, way in enumerate(ways)])
    assert (held.sum(axis=0) == 10).all()
    p = np.array([1, 2, 3, 4]) / 10
    assert np.abs(held.mean(axis=1) - 10 * p).max() < 0.05
    assert np.abs(np.cov(held) - 10 * (np.diag(p) - np.outer(p, p))).max() < 0.06


def loop(rows):
    alive = [r for r in rows if None not in r and not any(x != x for x in r)]
    return [r for r in rows if None in r or any(x != x for x in r) or not any(all(a >= b for a, b in zip(o, r, strict=True)) and o != r for o in alive)]


@pytest.mark.parametrize("block", [3, 50, skyline.BLOCK])
def test_skyline(spark, block):
    rng = random.Random(block)
    ties = [tuple(float(rng.randrange(4)) for _ in range(3)) for _ in range(200)]
    apart = [(float(i), float(200 - i), float(i % 3)) for i in range(200)]
    odd = [(None, 9.0, 9.0), (1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0), (-0.0, 4.0, 0.0), (0.0, 4.0, 0.0)]
    for rows in (ties, apart, odd, []):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, a double, b double, c double").repartition(5)
        got = skyline.pareto(df, ["a", "b", "c"], block)
        assert sorted(repr(tuple(r)[1:]) for r in got.collect()) == sorted(map(repr, loop(rows)))
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
