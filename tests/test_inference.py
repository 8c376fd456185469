"""Signed ranks and resampling against enumeration and plain loops."""

import itertools
import math
import random
from statistics import NormalDist

import numpy as np
import pytest

from glosswork.operators import resampling
from glosswork.operators import statistics as S


def ranked(d):
    d = [x for x in d if x]
    size = [abs(x) for x in d]
    return d, [sum(y < x for y in size) + (size.count(x) + 1) / 2 for x in size]


def enumerated(d):
    d, ranks = ranked(d)
    plus = sum(r for x, r in zip(d, ranks) if x > 0)
    low, hits = min(plus, sum(ranks) - plus), 0
    for signs in itertools.product((0, 1), repeat=len(d)):
        up = sum(r for s, r in zip(signs, ranks) if s)
        hits += min(up, sum(ranks) - up) <= low
    return hits / 2 ** len(d)


def normal(d, whole):
    d, ranks = ranked(d)
    n, plus = len(d), sum(r for x, r in zip(d, ranks) if x > 0)
    ties = sum(ranks.count(r) ** 3 - ranks.count(r) for r in set(ranks))
    sd = math.sqrt((n * (n + 1) * (2 * n + 1) - (ties if whole else ties / 2)) / 24)
    off = plus - n * (n + 1) / 4
    step = 0.5 if off > 0 else -0.5 if off < 0 else 0.0
    return min(1.0, 2 * NormalDist().cdf(-abs((off - step) / sd)))


def test_wilcoxon_equals_enumeration_and_normal_form(spark):
    rng = random.Random(2)
    few = [[rng.choice([-1, 1]) * (i + rng.random() / 2) for i in range(1, n + 1)] for n in (1, 2, 5, 9, 12)]
    many = [[float(rng.randint(-4, 6)) for _ in range(n)] for n in (8, 40, 300)]
    none = [[0.0, 0.0]]
    groups = few + many + none
    rows = [(g, 9, v, 0.0) for g, d in enumerate(groups) for v in d]
    got = {r.run_a: r for r in S.wilcoxon_tests(spark.createDataFrame(rows, "run_a int, run_b int, a double, b double")).collect()}
    assert len(got) == len(groups)
    for g, d in enumerate(groups):
        r = got[g]
        if d in none:
            assert (r.n, r.w_plus, r.p_exact, r.p_half_ties, r.method) == (0, 0.0, 1.0, 1.0, "NO_DIFFERENCE")
            continue
        assert r.n == len([x for x in d if x]) and r.w_plus + r.w_minus == r.n * (r.n + 1) / 2
        assert r.method == ("EXACT" if d in few else "NORMAL")
        assert r.p_exact == pytest.approx(enumerated(d) if d in few else normal(d, True))
        assert r.p_half_ties == pytest.approx(normal(d, False))


def test_bca(spark):
    rng = random.Random(4)
    skewed = [rng.expovariate(1.0) for _ in range(80)]
    rows = [("skewed", x) for x in skewed] + [("same", 2.0)] * 6 + [("one", 3.0), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in resampling.bootstrap_bca(df, ["g"], "v", resamples=4000).collect()}
    assert [(got[g].method, got[g].fallback, got[g].low, got[g].high) for g in ("same", "one")] == [("percentile", "DEGENERATE_SAMPLE", v, v) for v in (2.0, 3.0)]
    r = got["skewed"]
    assert (r.method, r.fallback, r.n) == ("bca", None, 80) and r["mean"] == pytest.approx(np.mean(skewed))
    # by resampled indices and a jackknife that leaves out one case at a time
    x = np.array(skewed)
    means = x[np.random.default_rng(1).integers(0, 80, (40000, 80))].mean(axis=1)
    left = np.array([np.delete(x, i).mean() for i in range(80)])
    c = left.mean() - left
    a = (c**3).sum() / (6 * (c**2).sum() ** 1.5)
    z0 = NormalDist().inv_cdf((means < x.mean()).mean())
    want = [np.quantile(means, NormalDist().cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))) for z in (-S.Z, S.Z)]
    assert [r.low, r.high] == pytest.approx(want, abs=0.03)
    plain = resampling.bootstrap(df.where("g = 'skewed'"), ["g"], "v", resamples=4000).first()
    assert r.low > plain.low and r.high > plain.high


def test_shared_draws(spark):
    rng = random.Random(3)
    rows = [("g", x, 2 * x) for x in (rng.gauss(0.2, 1) for _ in range(150))] + [("g", 50.0, None)]
    got = {r.metric: r for r in resampling.bootstrap_shared(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], ["x", "y"], resamples=500).collect()}
    x, y = got["x"], got["y"]
    assert x.n == y.n == 150
    for name in ("mean", "low", "high"):
        assert y[name] == pytest.approx(2 * x[name])
    assert x.p == y.p


def test_blocks_of_draws_do_not_change_them():
    v, n, held = np.arange(5.0)[:, None], np.array([3, 1, 4, 1, 5]), np.full(100, 14)
    assert (resampling.sums_of(v, n, held, [7]) == resampling.sums_of(v, n, held, [7], block=10)).all()


def test_lower_quantiles(spark):
    df = spark.createDataFrame([("g", float(i % 5)) for i in range(40)], "g string, d double")
    drawn, _ = resampling.resampled(df, ["g"], ["d"], 101, 20260825)
    means = np.sort([r._s_0 / 40 for r in drawn.collect()])
    r = resampling.bootstrap(df, ["g"], "d", resamples=101, plus_one=True, quantiles="lower").first()
    assert (r.low, r.high) == (means[int(0.025 * 100)], means[int(0.975 * 100)])
