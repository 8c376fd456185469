"""Prefix tries of conversations: every shared beginning once.

Rebuilt conversations share the first turns of the first conversation of their
hundred. Conversations with the same turns are one sequence with a weight and go
on as one. Sequences are hash-partitioned by the digest of their first turn and
each bucket builds pointer dictionary tries inside applyInPandas; a child comes
after its parent there, so one walk backwards is a postorder without recursion.
A first-turn subtrie with more turns than a task should hold is opened instead:
the turns that all its sequences share become a chain of nodes by aggregation,
and what follows is partitioned again by the next turn, until every subtrie
fits. The sums of opened nodes are then joined from below, round by round.

Only digests of turns and their lengths are shuffled, not texts. Positions come
from a range-partitioned sort with counts per partition (running()), and lists
of members are hashed as streams of sorted pieces, so neither a conversation
nor a group of copies is held in one task.

Defined cases: turns are ordered by turn, nulls first, then by the digest of role
and text (rows that repeat all three follow each other); null role or text is
empty; rows without a conv_id belong to no conversation and are left out; ids
below zero take the remainder's sign in c - c % 100; an empty table has no root
and gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import ROOT, materialize, shuffle_partitions, table

#: Turns that the first conversation of a hundred gives at most, plus one.
HEADS = 6
#: Turns of a subtrie that one task may hold: a share of all, within these bounds.
LEAST, MOST = 1_000, 100_000
ROOT_ID = b""


def running(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """df with pos (rows of the key before) and total (sum of value up to and with
    the row), keys of any size: rows are sorted over range partitions, each task
    counts its own, and only keys that cross partitions get an offset (there is
    at most one such key a partition)."""
    fields = [f for f in df.schema.fields]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, pos, total, begun = TaskContext.get().partitionId(), None, 0, 0, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            values = batch.column(value).to_numpy(zero_copy_only=False)
            new = np.append(True, keys[1:] != keys[:-1])
            begin = np.flatnonzero(new)
            own = np.repeat(begin, np.diff(np.append(begin, n)))
            sums = np.cumsum(values)
            places = np.arange(n) - own
            totals = sums - (sums[own] - values[own])
            if begun and keys[0] == last:
                same = own == 0
                places[same] += pos
                totals[same] += total
            heads = np.zeros(n, bool)
            heads[0] = not begun
            last, pos, total, begun = keys[-1], int(places[-1]) + 1, int(totals[-1]), True
            more = [pa.array(np.full(n, part)), pa.array(places), pa.array(totals), pa.array(heads)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_part", "pos", "total", "_first"])

    spark = df.sparkSession
    sorted_rows = df.repartitionByRange(shuffle_partitions(spark), key, *order).sortWithinPartitions(key, *order)
    rows = materialize(sorted_rows.mapInArrow(run, f"{kinds}, _part long, pos long, total long, _first boolean"), "running")
    crossing = F.broadcast(rows.where("_first").select(F.col(key).alias("_k")).distinct())
    parts = rows.join(crossing, F.col(key) == F.col("_k")).groupBy("_k", "_part").agg((F.max("pos") + 1).alias("n"), F.max_by("total", "pos").alias("sum"))
    parts = materialize(parts, "crossing")
    # At most one row a partition and crossing key: rows before are joined, not windowed.
    early = parts.select(F.col("_k").alias("_e"), F.col("_part").alias("_p"), "n", "sum")
    offsets = parts.select("_k", "_part").join(early, (F.col("_k") == F.col("_e")) & (F.col("_p") < F.col("_part")))
    offsets = offsets.groupBy("_k", F.col("_part").alias("_at")).agg(F.sum("n").alias("_n"), F.sum("sum").alias("_sum"))
    joined = rows.join(F.broadcast(offsets), (F.col(key) == F.col("_k")) & (F.col("_part") == F.col("_at")), "left")
    return joined.select(*(f.name for f in fields), (F.col("pos") + F.coalesce("_n", F.lit(0))).alias("pos"), (F.col("total") + F.coalesce("_sum", F.lit(0))).alias("total"))


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its hundred."""
    return (F.crc32(conv_id.cast("string")) % HEADS).cast("int")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, digest (16 bytes of role and text), chars of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    return running(rows.where("conv_id is not null"), "conv_id", ["turn", "digest"], "chars").select("conv_id", "pos", "digest", "chars")


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id, pos, digest, chars of the rebuilt conversations; pos -1 marks each of them once.

    A head is at most five turns of one conversation in a hundred.
    """
    heads = own.where((F.col("conv_id") % 100 == 0) & (F.col("pos") < HEADS - 1)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head"))
    base = F.col("conv_id") - F.col("conv_id") % 100
    # The own first row of a conversation carries its head, so each row meets the heads once.
    met = own.withColumn("base", base).join(heads, "base", "left").withColumn("h", shared_turns(F.col("conv_id")))
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,digest:binary,chars:bigint>>")), F.lit(1), F.col("h"))
    mark = F.array(F.struct(F.lit(-1).cast("long").alias("pos"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("chars")))
    shifted = F.array(F.struct((F.col("pos") - F.col("h") + F.size(taken)).cast("long").alias("pos"), "digest", "chars"))
    kept = F.when(F.col("pos") >= F.col("h"), shifted).otherwise(F.array().cast("array<struct<pos:bigint,digest:binary,chars:bigint>>"))
    given = F.when(F.col("pos") == 0, F.concat(mark, taken)).otherwise(F.array().cast("array<struct<pos:bigint,digest:binary,chars:bigint>>"))
    return met.select("conv_id", F.explode(F.concat(given, kept)).alias("t")).select("conv_id", "t.*")


RUN = "n_turns long, x long, y long, first binary, rep long, n long, ends string"


def _inner(batches):
    """Runs of equal sequences in sorted rows: those inside a batch are whole and get
    the SHA-256 of their list of ids, those at its edges may go on and keep the list."""
    import hashlib
    from itertools import groupby

    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        found = []
        for key, some in groupby(zip(*(batch.column(c).to_pylist() for c in ("n_turns", "x", "y", "first", "rep")), strict=True), key=lambda r: r[:4]):
            ids = [r[4] for r in some]
            found.append([*key, ids[0], len(ids), ",".join(map(str, ids)), False])
        found[0][7] = found[-1][7] = True
        for row in found:
            if not row[7]:
                row[6] = hashlib.sha256(row[6].encode()).hexdigest()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(_kinds(pa))], names=[*RUN.replace("long", "").replace("binary", "").replace("string", "").replace(" ", "").split(","), "open"])


def _kinds(pa):
    return [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]


def _streamed(batches):
    """One row for all sorted pieces of a sequence; their lists are hashed as they come."""
    import hashlib

    import pyarrow as pa

    names = ["n_turns", "x", "y", "first", "rep", "n", "ends"]
    held, digest = None, None

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_kinds(pa)[:7])], names=names)

    for batch in batches:
        done = []
        for *key, rep, n, ids in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if held and held[:4] == key:
                held[5] += n
                digest.update(("," + ids).encode())
                continue
            if held:
                done.append([*held, digest.hexdigest()])
            held, digest = [*key, rep, n], hashlib.sha256(ids.encode())
        yield out(done)
    if held:
        yield out([[*held, digest.hexdigest()]])


def sequences(rows: DataFrame) -> DataFrame:
    """One row per distinct rebuilt sequence: n_turns, x, y (its hash), first (digest of
    its first turn), rep (smallest member), n (members), ends (SHA-256 of their list).

    A group of copies is sorted over as many tasks as it needs. Its list is hashed
    in one task, for SHA-256 has no other way, as a stream of pieces.
    """
    root, turn = ROOT, F.col("pos") >= 0
    per = rows.groupBy("conv_id").agg(
        F.count(F.when(turn, 1)).alias("n_turns"),
        F.coalesce(F.bit_xor(F.when(turn, F.xxhash64("pos", "digest"))), F.lit(0)).alias("x"),
        F.coalesce(F.bit_xor(F.when(turn, F.xxhash64("digest", "pos", F.lit(1)))), F.lit(0)).alias("y"),
        F.max(F.when(F.col("pos") == 0, F.col("digest"))).alias("first"),
    )
    per = materialize(per.withColumnRenamed("conv_id", "rep"), "sequences")
    keys, parts = ["n_turns", "x", "y", "first"], shuffle_partitions(rows.sparkSession)

    def inner(batches):
        import sys

        if root not in sys.path:
            sys.path.append(root)
        from glosswork.llm.turn_tries import _inner

        return _inner(batches)

    def streamed(batches):
        import sys

        if root not in sys.path:
            sys.path.append(root)
        from glosswork.llm.turn_tries import _streamed

        return _streamed(batches)

    ranged = per.repartitionByRange(parts, *keys, "rep").sortWithinPartitions(*keys, "rep")
    runs = materialize(ranged.mapInArrow(inner, RUN + ", open boolean"), "runs")
    pieces = runs.where("open").drop("open").repartition(parts, *keys).sortWithinPartitions(*keys, "rep")
    return materialize(runs.where("not open").drop("open").unionByName(pieces.mapInArrow(streamed, RUN)), "distinct")


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def grow(pdf):
    """The nodes of a bucket's tries, columns of NODE and gid at the top ones.

    kids[i] maps a turn's digest to the child of node i. A child is made after its
    parent, so walking backwards meets all children before their parent.
    """
    import hashlib

    import pandas as pd

    none = hashlib.sha256(b"").hexdigest()
    pdf = pdf.sort_values(["rep", "pos"])
    tops, kids, up, depth, chars, n, conv, parent_conv, ends, top = {}, [], [], [], [], [], [], [], [], []
    last, at, under = None, -1, None
    for rep, pos, weight, digest, size, end, gid, gconv in zip(*(pdf[c].tolist() for c in ("rep", "pos", "n", "digest", "chars", "ends", "gid", "gconv")), strict=True):
        if rep != last:
            last, at, under = rep, -1, tops.setdefault(gid, {})
        node = under.get(digest)
        if node is None:
            node = under[digest] = len(up)
            kids.append({})
            up.append(at)
            depth.append(pos + 1)
            chars.append(size)
            n.append(0)
            conv.append(rep)
            parent_conv.append(conv[at] if at >= 0 else gconv)
            ends.append(none)
            top.append(gid if at < 0 else None)
        n[node] += weight
        if end is not None:
            ends[node] = end
        at, under = node, kids[node]
    leaves, saved = [0] * len(up), [0] * len(up)
    for i in range(len(up) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * chars[i]
        if up[i] >= 0:
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
    return pd.DataFrame({"conv_id": conv, "depth": depth, "parent_conv_id": parent_conv, "n_convs": n, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "gid": top})


def _opened(rows: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stems, rows of the stems' chains, rows that follow) of the subtries in large."""
    inside = materialize(rows.join(large, "child"), "opened")
    alike = inside.groupBy("child", "pos").agg(F.count("*").alias("c"), F.min("digest").alias("a"), F.max("digest").alias("b"), F.max("seqs").alias("seqs"))
    cut = alike.groupBy("child").agg(F.coalesce(F.min(F.when((F.col("c") < F.col("seqs")) | (F.col("a") != F.col("b")), F.col("pos"))), F.max("pos") + 1).alias("end"))
    inside = materialize(inside.join(cut, "child"), "stemmed")
    chain = inside.where("rep = child_conv and pos < end")
    stem_ends = inside.where("pos = end - 1 and n_turns = end").select("child", "ends")
    stems = chain.groupBy("child").agg(F.sum("chars").alias("stem_chars"), *(F.first(c).alias(c) for c in ("gid", "gconv", "child_conv", "weight", "end")))
    after = inside.where("pos >= end").drop("nd")
    following = inside.where("pos = end").select("rep", F.col("digest").alias("nd"))
    after = after.join(following, "rep").select("rep", "n", "n_turns", "ends", "pos", "digest", "chars", F.col("child").alias("gid"), F.col("child_conv").alias("gconv"), F.col("end").alias("depth"), "nd")
    return materialize(stems.join(stem_ends, "child", "left"), "stems"), chain, materialize(after, "after")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("child", F.unhex(F.substring(F.sha2(F.concat("gid", "nd"), 256), 1, 32)))


def nodes(conversations: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A subtrie of more turns than a quarter of a partition's share is opened, but
    none of up to least and every one of more than most.
    """
    spark, code = conversations.sparkSession, ROOT
    parts = shuffle_partitions(spark)
    rows = materialize(rebuilt(turns(conversations)), "rebuilt")
    seqs = sequences(rows)
    root = seqs.agg(F.min("rep").alias("conv"), F.sum("n").alias("n"), F.max(F.when(F.col("n_turns") == 0, F.col("ends"))).alias("ends")).first()
    if root.conv is None:
        return spark.createDataFrame([], NODE)
    ends = F.when(F.col("pos") == F.col("n_turns") - 1, F.col("ends"))
    now = rows.where("pos >= 0").join(seqs.withColumnRenamed("rep", "conv_id"), "conv_id")
    now = now.select(F.col("conv_id").alias("rep"), "n", "n_turns", ends.alias("ends"), "pos", "digest", "chars", F.lit(ROOT_ID).alias("gid"), F.lit(root.conv).alias("gconv"), F.lit(0).cast("long").alias("depth"), F.col("first").alias("nd"))
    now = materialize(now, "sequence-turns")
    total = now.count()
    limit = min(most, max(least, -(-total // (4 * parts))))

    small, rounds = [], []
    while True:
        keyed, begins = _keyed(now), F.col("pos") == F.col("depth")
        sizes = keyed.groupBy("child").agg(F.count("*").alias("size"), F.min("rep").alias("child_conv"), F.count(F.when(begins, 1)).alias("seqs"), F.sum(F.when(begins, F.col("n"))).alias("weight"))
        large = materialize(sizes.where(F.col("size") > limit).drop("size"), "large")
        if large.isEmpty():
            small.append(keyed)
            break
        small.append(keyed.join(large.select("child"), "child", "left_anti"))
        *opened, now = _opened(keyed, large)
        rounds.append(opened)

    def build(pdf):
        import sys

        if code not in sys.path:
            sys.path.append(code)
        from glosswork.llm.turn_tries import grow

        return grow(pdf)

    columns = ["rep", "pos", "n", "digest", "chars", "ends", "gid", "gconv"]
    bucket = F.pmod(F.xxhash64("child"), F.lit(max(parts, -(-total // limit)))).alias("bucket")
    closed = reduce(DataFrame.unionByName, (s.select(bucket, *columns) for s in small))
    closed = materialize(closed.groupBy("bucket").applyInPandas(build, NODE + ", gid binary"), "tries")

    below = closed.where("gid is not null").select("gid", "n_leaves", "saved_tokens", F.lit(1).alias("kids"))
    found = [closed.drop("gid")]
    none = F.sha2(F.lit(""), 256)
    for stems, chain in reversed(rounds):
        sums = below.groupBy(F.col("gid").alias("child")).agg(*(F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens", "kids")))
        filled = [F.coalesce(c, F.lit(v)).alias(c) for c, v in (("n_leaves", 1), ("saved_tokens", 0), ("kids", 0))]
        met = materialize(stems.join(sums, "child", "left").select(*stems.columns, *filled), "stem-sums")
        own = F.col("saved_tokens") + (F.col("weight") - 1) * F.col("stem_chars")
        below = below.unionByName(met.select("gid", "n_leaves", own.alias("saved_tokens"), F.lit(1).alias("kids")))
        line = running(chain.select(F.col("child_conv").alias("key"), "pos", "chars").withColumnRenamed("pos", "turn"), "key", ["turn"], "chars")
        bottom, first = F.col("turn") == F.col("end") - 1, F.col("pos") == 0
        on_line = line.join(met.withColumnRenamed("child_conv", "key"), "key").select(
            F.col("key").alias("conv_id"),
            (F.col("turn") + 1).alias("depth"),
            F.when(first, F.col("gconv")).otherwise(F.col("key")).alias("parent_conv_id"),
            F.col("weight").alias("n_convs"),
            F.when(bottom, F.col("kids")).otherwise(1).cast("long").alias("n_children"),
            "n_leaves",
            (F.col("saved_tokens") + (F.col("weight") - 1) * (F.col("stem_chars") - F.col("total") + F.col("chars"))).alias("saved_tokens"),
            F.when(bottom & F.col("ends").isNotNull(), F.col("ends")).otherwise(none).alias("ends_sha256"),
        )
        found.append(on_line)
    tops = below.where(F.col("gid") == F.lit(ROOT_ID)).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kids", "n_leaves", "saved_tokens"))).first()
    empty = root.ends or hashlib.sha256(b"").hexdigest()
    found.append(spark.createDataFrame([(root.conv, 0, None, root.n, tops.kids, max(1, tops.n_leaves), tops.saved_tokens, empty)], NODE))
    return reduce(DataFrame.unionByName, found)


def query(spark, sf_dir):
    return nodes(table(spark, sf_dir, "conversations"))


SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS seq
  FROM t GROUP BY conv_id),
bits AS (
  SELECT conv_id, seq, list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
           lambda c: [ord(c)::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]))) AS steps
  FROM own),
shares AS (
  SELECT conv_id, seq,
         xor(list_reduce(steps, lambda crc, b: xor(xor(crc, b) >> 1, (xor(crc, b) & 1::UBIGINT) * 3988292384::UBIGINT)),
             4294967295::UBIGINT) % 6 AS h
  FROM bits),
built AS (
  SELECT a.conv_id, list_concat(list_slice(coalesce(b.seq, []), 1, a.h::BIGINT), list_slice(a.seq, a.h::BIGINT + 1, len(a.seq))) AS seq
  FROM shares a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
prefixes AS (
  SELECT conv_id, d AS depth, list_slice(seq, 1, d) AS p, len(seq) = d AS is_end,
         CASE WHEN d = 0 THEN 0 ELSE length(seq[d].text) END AS chars
  FROM built, unnest(range(0, len(seq) + 1)) u(d)),
node AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM prefixes GROUP BY p, depth),
kids AS (
  SELECT list_slice(p, 1, depth - 1) AS p, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
own_sums AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM node n LEFT JOIN kids k ON k.p = n.p AND k.depth = n.depth),
subtree AS (
  SELECT list_slice(p, 1, d) AS p, d AS depth, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM own_sums, unnest(range(0, depth + 1)) u(d) GROUP BY ALL)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM own_sums n JOIN subtree s ON s.p = n.p AND s.depth = n.depth
LEFT JOIN node up ON up.depth = n.depth - 1 AND up.p = list_slice(n.p, 1, n.depth - 1)
"""
