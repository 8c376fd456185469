"""Exact vector search, ranking, diversity, budgets, citations, ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.session import written


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in double, clamped to [0, 1]; null for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return clamp(F.try_divide(dot, norm(a) * norm(b)))


def clamp(score: Column) -> Column:
    return F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))


def valid_vector(v: Column, dims: int) -> Column:
    """Not null, of dims finite numbers."""
    return v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


#: Vectors of a block of queries and of a block of chunks, and most results of a query.
QUERY_BLOCK, CHUNK_BLOCK, MOST = 512, 2048, 50


def _blocks(rows: DataFrame, key: str, vector: str, size: int, name: str, ties: Sequence[Column] = ()) -> DataFrame:
    """One array of (tie, v) a row in the order of ties and id, dealt by the id's hash, of about size vectors each.

    Vectors that are null, of another length than the first's kind or not finite don't take part.
    """
    tie = F.struct(*(c.alias(f"t{i}") for i, c in enumerate(ties)), F.col(key).cast("long").alias("id"))
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(tie.alias("tie"), F.col(vector).alias("v"))
    n = max(1, -(-rows.count() // size))
    block = F.pmod(F.xxhash64("tie.id"), F.lit(n)).alias("_block")
    return rows.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("tie", "v"))).alias(name)).select(name)


def top_k(
    queries: DataFrame, chunks: DataFrame, k: int, query_id: str = "query_id", chunk_id: str = "vec_id", vector: str = "embedding", ties: Sequence[Column] = (), minimum: float | None = None, dims: int | None = None
) -> DataFrame:
    """query_id, chunk_id, score, rank of the k nearest chunks of each query, itself excluded.

    The order is that of the raw cosine (to twelve digits), then of ties (columns
    of chunks, ascending; a descending date is its negative day number), then of
    the id. The score that is returned is clamped to [0, 1]; minimum is held against
    it. k is 1 to 50. Vectors that are not of dims finite numbers don't take part
    (dims: by default that of a chunk), nor do zero vectors, whose cosine is undefined.

    Queries and chunks meet in blocks of bounded size, so neither the driver nor
    a task holds all of either. Every pair of blocks is one matrix product and
    keeps its own k best of each query; the final ranking is a window whose
    group limit Spark pushes below the exchange.
    """
    if not 1 <= k <= MOST:
        raise ValueError(f"k must be 1 to {MOST}")
    if dims is None:
        first = chunks.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
        dims = first[0] if first else 0
    fits = F.size(vector) == dims
    right = _blocks(chunks.where(fits), chunk_id, vector, CHUNK_BLOCK, "c", ties)
    left = _blocks(queries.where(fits), query_id, vector, QUERY_BLOCK, "q")
    tie = right.schema["c"].dataType.elementType["tie"].dataType

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def block(cell):
            rows = cell.values
            v = np.array(rows.field("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), -1)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            return rows.field("tie"), v / np.where(norm > 0, norm, np.nan)

        for batch in batches:
            for asked, there in zip(batch.column("q"), batch.column("c"), strict=True):
                (one, q), (own, m) = block(asked), block(there)
                ids, others = (x.field("id").to_numpy(zero_copy_only=False) for x in (one, own))
                score = np.round(q @ m.T, 12)
                score[(ids[:, None] == others[None, :]) | np.isnan(score)] = -np.inf
                n = min(k, len(own))
                best = np.argsort(-score, axis=1, kind="stable")[:, :n]
                rows = np.repeat(np.arange(len(ids)), n)
                flat = best.ravel()
                kept = score[rows, flat] > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[kept]]), own.take(pa.array(flat[kept])), pa.array(score[rows[kept], flat[kept]])], names=["q", "tie", "raw"])

    local = left.crossJoin(right).mapInArrow(run, f"q long, tie {tie.simpleString()}, raw double")
    if minimum is not None:
        local = local.where(clamp(F.col("raw")) >= minimum)
    w = Window.partitionBy("q").orderBy(F.desc("raw"), "tie")
    ranked = local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("tie.id").alias(chunk_id), clamp(F.col("raw")).alias("score"), "rank")


def above(queries: DataFrame, chunks: DataFrame, minimum: float, query_id: str = "query_id", chunk_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, n, best: how many chunks reach a clamped cosine of minimum for each query that has any, itself excluded.

    Blocks meet as in top_k(); each pair of blocks gives one row a query.
    """
    first = chunks.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    fits = F.size(vector) == (first[0] if first else 0)
    right = _blocks(chunks.where(fits), chunk_id, vector, CHUNK_BLOCK, "c")
    left = _blocks(queries.where(fits), query_id, vector, QUERY_BLOCK, "q")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def block(cell):
            rows = cell.values
            v = np.array(rows.field("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), -1)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            return rows.field("tie").field("id").to_numpy(zero_copy_only=False), v / np.where(norm > 0, norm, np.nan)

        for batch in batches:
            for asked, there in zip(batch.column("q"), batch.column("c"), strict=True):
                (ids, q), (others, m) = block(asked), block(there)
                score = np.clip(np.round(q @ m.T, 12), 0.0, 1.0)
                held = (score >= minimum) & (ids[:, None] != others[None, :])
                best = np.where(held, score, -1.0).max(axis=1, initial=-1.0)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(held.sum(axis=1)), pa.array(best)], names=["q", "n", "best"])

    met = left.crossJoin(right).mapInArrow(run, "q long, n long, best double").where("n > 0")
    return met.groupBy(F.col("q").alias(query_id)).agg(F.sum("n").alias("n"), F.max("best").alias("best"))


def diversify(ranked: DataFrame, query: str, document: str, section: str, per_document: int = 2, per_section: int = 1) -> DataFrame:
    """Adds disposition and context_rank: at most so many chunks per section, then per document.

    Both caps are monotone in rank, so two row numbers equal the sequential rule.
    """
    by_section = Window.partitionBy(query, document, section).orderBy("rank")
    by_document = Window.partitionBy(query, document, "_in").orderBy("rank")
    running = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranked.withColumn("_in", F.row_number().over(by_section) <= per_section)
    rows = rows.withColumn("_sel", F.col("_in") & (F.row_number().over(by_document) <= per_document))
    place = F.sum(F.col("_sel").cast("int")).over(running)
    return rows.withColumn("disposition", F.when(F.col("_sel"), "SELECTED").otherwise("EXCLUDED_DIVERSITY")).withColumn("context_rank", F.when(F.col("_sel"), place)).drop("_in", "_sel")


def citation(rank: Column) -> Column:
    """SRC-001 to SRC-999; null outside."""
    return F.when(rank.between(1, 999), F.format_string("SRC-%03d", rank))


#: The words that bound evidence in a prompt.
MARKERS = ("EVIDENCE_DATA_BEGIN", "EVIDENCE_DATA_END", "[/EVIDENCE", "[EVIDENCE")


def evidence_value(text: Column, fallback: str = "unknown") -> Column:
    """One line of a value: white space squashed, reserved markers suffixed."""
    plain = F.trim(F.regexp_replace(F.when(text != "", text).otherwise(fallback), r"\s+", " "))
    for marker in MARKERS:
        plain = F.replace(plain, F.lit(marker), F.lit(f"{marker}_ESCAPED"))
    return plain


def evidence_block(cite: Column, title: Column, external_id: Column, published: Column, section: Column, article: Column, extract: Column) -> Column:
    """The eight lines of a citable source; values are data and cannot close the block."""
    fields = [("title", title, "unknown"), ("external_id", external_id, "unknown"), ("publication_date", published, "unknown"), ("section", section, "unknown"), ("article", article, "none"), ("extract", extract, "")]
    lines = [F.concat(F.lit(f"{name}="), evidence_value(F.coalesce(value, F.lit("")), fallback)) for name, value, fallback in fields]
    return F.concat_ws("\n", F.concat(F.lit("[EVIDENCE "), cite, F.lit(" DATA_ONLY]")), *lines, F.concat(F.lit("[/EVIDENCE "), cite, F.lit("]")))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("long")


def budget_pack(blocks: DataFrame, group: str, order: str, max_bytes: int, max_tokens: int, sizes: tuple[str, str] = ("bytes", "tokens"), separator: int = 2) -> DataFrame:
    """group, picked: keys in order that fit the budgets; one that doesn't fit is skipped, later ones may.

    A fold over a group's blocks; callers bound the group (a retrieval pool).
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(sizes[0]).cast("long").alias("b"), F.col(sizes[1]).cast("long").alias("t"))))
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("t"), F.expr("cast(array() as array<bigint>)").alias("picked"))

    def step(acc, x):
        cost = x["b"] + F.lit(separator)
        fits = (acc["b"] + cost <= max_bytes) & (acc["t"] + x["t"] <= max_tokens)
        return F.struct(F.when(fits, acc["b"] + cost).otherwise(acc["b"]).alias("b"), F.when(fits, acc["t"] + x["t"]).otherwise(acc["t"]).alias("t"), F.when(fits, F.concat(acc["picked"], F.array(x["at"].cast("long")))).otherwise(acc["picked"]).alias("picked"))

    return blocks.groupBy(group).agg(listed.alias("_l")).select(group, F.aggregate("_l", start, step, lambda a: a["picked"]).alias("picked"))


#: Blocks of a group that one round of budget_fold looks at.
ROUND = 1024


def budget_fold(blocks: DataFrame, group: str, order: str, max_bytes: int, max_tokens: int, sizes: tuple[str, str] = ("bytes", "tokens"), separator: int = 2) -> DataFrame:
    """group, order of all blocks that budget_pack would pick, for groups of any size.

    The room left never grows, so a block that exceeds it once never fits. Each
    round folds the first ROUND blocks of a group that still fit after the last one
    looked at; the first of them always fits, so every round picks one at least in
    each group that is left, and most groups end after a few rounds.
    """
    size_b, size_t = (F.col(c).cast("long") for c in sizes)
    rows = blocks.select(F.col(group).alias("_g"), F.col(order).cast("long").alias("_o"), size_b.alias("_b"), size_t.alias("_t"))
    left = rows.where((F.col("_b") + separator <= max_bytes) & (F.col("_t") <= max_tokens))
    picked, state = None, None
    while True:
        if state is not None:
            near = rows.join(state, F.col("_g").eqNullSafe(F.col("_k")))
            left = near.where((F.col("_o") > F.col("_at")) & (F.col("_b") + separator <= F.col("_rb")) & (F.col("_t") <= F.col("_rt")))
        else:
            left = left.withColumn("_rb", F.lit(max_bytes).cast("long")).withColumn("_rt", F.lit(max_tokens).cast("long"))
        place = F.row_number().over(Window.partitionBy("_g").orderBy("_o"))
        pool = left.select("_g", "_o", "_b", "_t", "_rb", "_rt", place.alias("_n")).where(F.col("_n") <= ROUND)
        listed = F.array_sort(F.collect_list(F.struct("_o", "_b", "_t"))).alias("l")
        pool = pool.groupBy("_g").agg(listed, F.first("_rb").alias("_rb"), F.first("_rt").alias("_rt"))
        start = F.struct(F.col("_rb").alias("b"), F.col("_rt").alias("t"), F.expr("cast(array() as array<bigint>)").alias("p"))

        def step(acc, x):
            cost = x["_b"] + F.lit(separator)
            fits = (cost <= acc["b"]) & (x["_t"] <= acc["t"])
            grown = F.struct((acc["b"] - cost).alias("b"), (acc["t"] - x["_t"]).alias("t"), F.concat(acc["p"], F.array(x["_o"])).alias("p"))
            return F.when(fits, grown).otherwise(acc)

        folded = written(pool.select("_g", F.aggregate("l", start, step).alias("f"), F.array_max(F.transform("l", lambda x: x["_o"])).alias("_at"), (F.size("l") == ROUND).alias("full")), "fold")
        part = folded.select(F.col("_g").alias(group), F.explode("f.p").alias(order))
        picked = part if picked is None else picked.unionByName(part)
        # A group whose blocks were fewer than a round's has none left.
        state = folded.where("full").select(F.col("_g").alias("_k"), F.col("f.b").alias("_rb"), F.col("f.t").alias("_rt"), "_at")
        if state.isEmpty():
            return picked


# Ranking metrics over columns: retrieved array, relevant array or gains map.


def precision_at(retrieved: Column, relevant: Column, k: int, by_window: bool = False) -> Column:
    window = F.slice(retrieved, 1, k)
    hits = F.size(F.filter(window, lambda x: F.array_contains(relevant, x)))
    return F.try_divide(hits.cast("double"), F.size(window).cast("double") if by_window else F.lit(float(k)))


def recall_at(retrieved: Column, relevant: Column, k: int, distinct: bool = True) -> Column:
    """Null without labels; distinct=False counts a repeated hit each time."""
    window = F.slice(retrieved, 1, k)
    hits = F.size(F.array_intersect(window, relevant)) if distinct else F.size(F.filter(window, lambda x: F.array_contains(relevant, x)))
    return F.try_divide(hits.cast("double"), F.size(F.array_distinct(relevant)).cast("double"))


def reciprocal_rank(retrieved: Column, relevant: Column, k: int | None = None) -> Column:
    window = F.slice(retrieved, 1, k) if k else retrieved
    flags = F.transform(window, lambda x: F.array_contains(relevant, x))
    at = F.array_position(flags, True)
    return F.when(F.size(relevant) == 0, None).otherwise(F.when(at > 0, 1.0 / at).otherwise(0.0))


def hits_precision(gains: Column, k: int, by_window: bool = False) -> Column:
    """precision_at from the gains of what was retrieved, in order: over 0 is a hit."""
    window = F.slice(gains, 1, k)
    hits = F.size(F.filter(window, lambda g: g > 0)).cast("double")
    return F.try_divide(hits, F.size(window).cast("double") if by_window else F.lit(float(k)))


def hits_recall(gains: Column, n_relevant: Column, k: int) -> Column:
    """recall_at of distinct results from their gains and the number of relevant ids; null without labels."""
    return F.try_divide(F.size(F.filter(F.slice(gains, 1, k), lambda g: g > 0)).cast("double"), n_relevant.cast("double"))


def hits_reciprocal_rank(gains: Column, n_relevant: Column, k: int) -> Column:
    at = F.array_position(F.transform(F.slice(gains, 1, k), lambda g: g > 0), True)
    return F.when(n_relevant == 0, None).otherwise(F.when(at > 0, 1.0 / at).otherwise(0.0))


def ndcg_at(gains: Column, ideal: Column, k: int) -> Column:
    """gains: of the retrieved in order; ideal: of all relevant. Null when ideal is empty."""

    def dcg(values):
        parts = F.transform(F.slice(values, 1, k), lambda g, i: g.cast("double") / F.log2(i + F.lit(2.0)))
        return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)

    return F.try_divide(dcg(gains), dcg(F.sort_array(ideal, asc=False)))


def violations(**checks: Column) -> Column:
    """Codes of the checks that are true."""
    return F.array_compact(F.array(*(F.when(c, F.lit(code)) for code, c in checks.items())))
