"""Prefix tries against a brute-force version over all prefixes, opened subtries included."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from glosswork.llm import turn_tries

KINDS = "conv_id long, turn long, role string, text string, n_convs string, gid string, digest string, depth string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    for turns in own.values():
        turns.sort()
    built = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        built[conv] = tuple(t[3:] for t in own.get(conv - (conv % 100 if conv > 0 else -(-conv % 100)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for conv, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    leaves, saved, kids = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += kids[node] == 0
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if built[c] == node))
        up = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), up, len(convs), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], KINDS).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def talk(seed, n, deep):
    """Conversations over few turns, so that they share beginnings; some are long, some copies."""
    rng = random.Random(seed)
    rows = []
    for conv in range(0, 3 * n, 3):
        size = deep if conv % 60 == 0 else rng.randrange(9)
        word = rng.choice("ab") if size < deep else "a"
        for turn in range(size):
            rows.append((conv, turn, rng.choice(["user", "user", None]) if size < deep else "user", word * (1 + rng.randrange(2)) if size < deep else f"turn {turn}"))
    rows += [(conv, turn, "user", "copy") for conv in range(1, 200, 6) for turn in range(12)]
    return rows


ODD = [
    (0, 1, "user", "late"), (0, None, "system", "first"), (0, 0, None, None), (0, 0, None, None), (0, 0, "b", ""),
    (7, 5, "user", "x" * 150_000), (7, 2, "user", "é日本😀"), (None, 0, "user", "nowhere"), (205, 0, "user", "no first of its hundred"),
    (300, 0, "user", ""), (301, 0, "", "user"), (302, 0, "us", "er"), (-5, 0, "user", "below"), (2**62, 3, "user", "far"),
]


@pytest.mark.parametrize("least, most", [(turn_tries.LEAST, turn_tries.MOST), (1, 1), (10, 20)])
def test_nodes(spark, least, most):
    for rows in (ODD, talk(1, 60, 40)):
        assert got(turn_tries.nodes(frame(spark, rows), least, most)) == brute(rows)


def test_given_table(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in real.select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    assert got(turn_tries.query(spark, sf_dir)) == want
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    found = con.execute(turn_tries.SQL)
    columns = [d[0] for d in found.description]
    order = [columns.index(c) for c in turn_tries.NODE.replace(" long", "").replace(" string", "").split(", ")]
    assert sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr) == want


def test_empty_and_turnless(spark):
    assert got(turn_tries.nodes(frame(spark, []))) == []
    # h of 205 is 1 or more, so that its one turn goes and nothing is left.
    turnless = next(c for c in range(201, 299) if zlib.crc32(str(c).encode()) % 6)
    rows = [(turnless, 0, "user", "gone")]
    assert got(turn_tries.nodes(frame(spark, rows))) == brute(rows)


def test_running_crosses_partitions(spark):
    rows = [(k, i, 1 + i % 3) for k, n in ((1, 5), (2, 4000), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        for r in turn_tries.running(df, "k", ["i"], "v").collect():
            assert (r.pos, r.total) == (r.i, sum(1 + j % 3 for j in range(r.i + 1)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
