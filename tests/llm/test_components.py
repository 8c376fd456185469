"""Connected components: the steps they take and the links that the near-duplicate stage gives them."""

import random

import pytest

from glosswork.llm import components, near_copies, simhash

PAIR = "a long, b long"


@pytest.fixture
def tables(monkeypatch):
    """The label of every table that the components write."""
    made, whole = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: made.append(label) or whole(df, label))
    return made


def roots(spark, links):
    return {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, PAIR), "a", "b").collect()}


def test_stars_take_no_step(spark, tables):
    assert roots(spark, [(9, 3), (3, 7), (8, 3), (5, 5), (4, 2)]) == {7: 3, 8: 3, 9: 3, 4: 2}
    assert roots(spark, []) == {}
    assert tables == ["links"] * 2


def test_no_step_runs_after_the_stars(spark, tables):
    """One step joins two links of one node; no second is needed to see it."""
    assert roots(spark, [(1, 3), (2, 3)]) == {2: 1, 3: 1}
    assert tables == ["links"] * 2


@pytest.mark.parametrize("seed", range(3))
def test_any_links(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(50)] + [(k, k + 1) for k in range(100, 130)]
    links += rng.sample(links, 20) + [(b, a) for a, b in rng.sample(links, 20)]
    root = {n: n for ab in links for n in ab}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert roots(spark, links) == {n: r for n, r in root.items() if n != r}


def test_late_links_join_roots(spark, monkeypatch):
    """x and y meet at no end of a shingle; the components after that start from roots, not from all links again."""
    x = [f"w3x{i}" for i in range(100)]
    y = [*x[:-5], *(f"n{i}" for i in range(5))]
    assert (simhash.fingerprint(" ".join(x)) ^ simhash.fingerprint(" ".join(y))).bit_count() > simhash.DISTANCE
    parts = sorted({" ".join(t[i : i + 5]) for t in (x, y) for i in range(96)})
    rows = [(at + i, p) for i, p in enumerate(parts) for at in (0, 3000, 4000)] + [(1000, " ".join(x)), (1001, " ".join(y))]
    given, whole = [], components.connected_components
    monkeypatch.setattr(near_copies, "connected_components", lambda links, a, b: given.append(links.count()) or whole(links, a, b))
    got = {r.node: r.root for r in near_copies.near_links(spark.createDataFrame(rows, "node long, text string")).collect()}
    assert got == {at + i: i for i in range(len(parts)) for at in (3000, 4000)} | {1001: 1000}
    assert given == [3 * len(parts), 2 * len(parts) + 1]
