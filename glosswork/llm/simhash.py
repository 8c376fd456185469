"""SimHash near-duplicates by segment popcounts.

A fingerprint is a bit-wise majority over the XXH64 values of word shingles.
Its 64 bits are read as 32 segments of two bits; the embedding is the vector of
segment popcounts (0, 1 or 2). One flipped bit moves one count by one, so the
Manhattan distance of two embeddings never exceeds the Hamming distance. Counts
are kept in unary (00, 01, 11): the Manhattan distance is then the number of
bits in which two embeddings differ.

Grid range join: the segments form G groups. Two embeddings within distance D
agree in G - D groups at least, so each fingerprint enters the cells named by
the counts of every choice of G - D groups, and fingerprints that share a cell
meet under the Manhattan bound and then under the exact Hamming distance.
Nothing within D is missed. Only distinct fingerprints take part (copies and
equal fingerprints are joined beforehand), only verified links leave the join,
and a crowded cell is an ordinary skewed key of a sort-merge join.

Defined cases: null text counts as empty; a text without words has fingerprint
zero and is linked like any other; repeated rows share a class; rows with a
null id get the class of their fingerprint but name none; other columns are
not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import ROOT, materialize, table, text_of
from glosswork.llm.components import connected_components

SEED, SHINGLE, DISTANCE = 42, 4, 4
SEGMENTS = 32


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    import numpy as np
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
        hashes = [xxhash.xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=True)]
    votes = np.zeros(64, np.int64)
    values = np.array(hashes, ">u8")
    for at in range(0, len(values), 65536):
        votes += np.unpackbits(values[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    root = ROOT

    def run(batches):
        import sys

        import numpy as np
        import pyarrow as pa

        if root not in sys.path:
            sys.path.append(root)
        from glosswork.llm.simhash import fingerprint

        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return text_of(docs).mapInArrow(run, "doc_id long, fp long")


def embedding(fp):
    """Popcounts of the two-bit segments, each in unary."""
    low = 0x5555555555555555
    above = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(above).bitwiseAND(F.lit(low)), fp.bitwiseAND(above).bitwiseAND(F.lit(low))
    return some.bitwiseOR(F.shiftleft(both, 1))


def groups_for(count: int, distance: int = DISTANCE) -> int:
    """Groups so that a cell holds a few dozen of count random fingerprints."""
    for groups in range(distance + 2, SEGMENTS + 1):
        if count <= 64 * 2 ** (1.5 * SEGMENTS * (groups - distance) / groups):
            return groups
    return SEGMENTS


def cell_masks(groups: int, distance: int = DISTANCE) -> list[int]:
    """A mask of the embedding for every choice of groups - distance groups."""
    edges = [SEGMENTS * g // groups for g in range(groups + 1)]
    part = [sum(3 << 2 * s for s in range(edges[g], edges[g + 1])) for g in range(groups)]
    masks = [sum(part[g] for g in chosen) for chosen in combinations(range(groups), groups - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_links(distinct: DataFrame, groups: int, distance: int = DISTANCE) -> DataFrame:
    """a, b: fingerprints within distance, a < b, for a table of distinct fp."""
    masks = F.array(*map(F.lit, cell_masks(groups, distance)))
    cells = distinct.select("fp", embedding(F.col("fp")).alias("counts")).select("fp", "counts", F.posexplode(masks).alias("choice", "mask"))
    cells = cells.select("fp", "counts", "choice", F.col("counts").bitwiseAND(F.col("mask")).alias("cell"))
    a, b = cells.alias("a"), cells.alias("b")
    return (
        a.hint("merge")
        .join(
            b,
            (F.col("a.choice") == F.col("b.choice"))
            & (F.col("a.cell") == F.col("b.cell"))
            & (F.col("a.fp") < F.col("b.fp"))
            & (F.bit_count(F.col("a.counts").bitwiseXOR(F.col("b.counts"))) <= distance)
            & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance),
        )
        .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) of every row."""
    rows = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    links = near_links(distinct, groups_for(distinct.count(), distance), distance)
    roots = connected_components(links, "a", "b")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    # A root may have very many fingerprints: its minimum is a partial one, and the
    # key of that side is written so that both are dealt for the join, which Spark may split.
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id")).select(F.bitwise_not(F.bitwise_not("root")).alias("_root"), "component_id")
    classes = rooted.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(classes, rows["fp"] == classes["_fp"]).select("doc_id", "fp", "component_id")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that name their group: one document of each stays.

    Rows without an id stay, since nothing can name them; rows that share the
    id that stays stay together.
    """
    firsts = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    own = F.col("_row.doc_id").cast("long")
    kept = rows.where(own.isNotNull()).join(firsts, own == F.col("_first"), "left_semi")
    return kept.unionByName(rows.where(own.isNull())).select("_row.*")


def query(spark, sf_dir):
    return digest(near_duplicates(table(spark, sf_dir, "documents")))
