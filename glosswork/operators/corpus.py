"""Chunking, in-batch deduplication, leakage, deterministic embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import text as T


def sections(text: Column) -> Column:
    """array<struct<kind, number, lines>>: lines from one marker to the next.

    A fold over the lines of one document. Lines before the first marker are a
    TITLE (one non-empty line) or a HEADER; a document without markers is one
    UNKNOWN section.
    """
    lines = F.split(F.regexp_replace(text, r"\r\n|\r", "\n"), "\n")
    mark = lambda s, i: F.struct(i.alias("at"), T.section_of(s).alias("kind"), T.article_number(s).alias("number"))
    marks = lambda ls: F.filter(F.transform(ls, mark), lambda m: m["kind"].isNotNull())
    return T.let(lines, lambda ls: T.let(marks(ls), lambda ms: _cut(ls, ms)))


def _cut(lines: Column, marks: Column) -> Column:
    last = F.size(lines)
    none = F.lit(None).cast("string")
    main = F.transform(
        marks,
        lambda m, i: F.struct(m["kind"].alias("kind"), F.when(m["kind"] == "ARTICLE", m["number"]).alias("number"), F.slice(lines, m["at"] + 1, F.coalesce(F.get(marks, i + 1)["at"], last) - m["at"]).alias("lines")),
    )
    head = F.slice(lines, F.lit(1), F.coalesce(F.get(marks, F.lit(0))["at"], last))
    filled = F.size(F.filter(head, lambda s: F.btrim(s) != ""))
    before = F.when(F.size(marks) == 0, F.array(F.struct(F.lit("UNKNOWN").alias("kind"), none.alias("number"), lines.alias("lines")))).when(
        filled > 0, F.array(F.struct(F.when(filled == 1, "TITLE").otherwise("HEADER").alias("kind"), none.alias("number"), head.alias("lines")))
    )
    return F.concat(F.coalesce(before, F.slice(main, 1, 0)), main)


def paragraphs(lines: Column) -> Column:
    """Blank-separated paragraphs, the lines of each joined by a space."""
    joined = F.array_join(F.transform(lines, lambda s: F.btrim(s, F.lit(" \t"))), "\n")
    return F.filter(F.transform(F.split(joined, r"\n{2,}"), lambda p: F.btrim(F.regexp_replace(p, r"\n", " "))), lambda p: p != "")


def pack_paragraphs(parts: Column, limit: int) -> Column:
    """Greedy groups of whole paragraphs, at most limit characters with two for each separator; a longer paragraph is a group."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"))

    def step(acc, p):
        grown = F.concat(acc["now"], F.lit("\n\n"), p)
        fits = F.length(grown) <= limit
        return (
            F.when(acc["now"] == "", F.struct(acc["done"].alias("done"), p.alias("now")))
            .when(fits, F.struct(acc["done"].alias("done"), grown.alias("now")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), p.alias("now")))
        )

    return F.aggregate(parts, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))


def chunks(docs: DataFrame, key: str, text: str, limit: int = 12_000) -> DataFrame:
    """key, chunk_index, section_index, kind, number, content, tokens, sha256 of every chunk; an article is never split.

    Sections, paragraphs and groups stay in one row until they are numbered, so nothing is shuffled.
    """

    def cut(s, i):
        grouped = T.let(paragraphs(s["lines"]), lambda p: F.when(s["kind"] == "ARTICLE", F.filter(F.array(F.array_join(p, "\n\n")), lambda x: x != "")).otherwise(pack_paragraphs(p, limit)))
        return F.transform(grouped, lambda c: F.struct(i.alias("section_index"), s["kind"].alias("kind"), s["number"].alias("number"), c.alias("content")))

    rows = docs.select(key, F.posexplode(F.flatten(F.transform(sections(F.col(text)), cut))).alias("chunk_index", "c")).select(key, "chunk_index", "c.*")
    return rows.select(key, "chunk_index", "section_index", "kind", "number", "content", T.token_count(F.col("content")).alias("tokens"), F.sha2("content", 256).alias("sha256"))


def in_batch_outcomes(batch: DataFrame, identity: list[str], digest: str, order: str) -> DataFrame:
    """Adds outcome in batch order: identity before digest.

    UNCHANGED or UPDATED against the previous row of the identity, else
    DUPLICATE if any earlier row has the digest, else CREATED. The first row of
    a digest comes from a grouped minimum, so copies never meet in one task.
    """
    first = batch.groupBy(F.col(digest).alias("_d")).agg(F.min(order).alias("_first"))
    before = F.lag(digest).over(Window.partitionBy(*identity).orderBy(order))
    rows = batch.withColumn("_before", before).join(first, F.col(digest) == F.col("_d"))
    outcome = F.when(F.col("_before") == F.col(digest), "UNCHANGED").when(F.col("_before").isNotNull(), "UPDATED").when(F.col("_first") < F.col(order), "DUPLICATE").otherwise("CREATED")
    return rows.withColumn("outcome", outcome).drop("_before", "_d", "_first")


def hash_embedding(text: Column, dims: int) -> Column:
    """Deterministic vector: byte i mod 32 of the SHA-256, over 127.5, less one."""
    digest = F.sha2(text, 256)
    byte = lambda i: F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: byte(i) / 127.5 - 1.0)


def uuid5(namespace: str):
    """A function of names: their version-5 UUIDs."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def make(names):
        import uuid

        space = uuid.UUID(namespace)
        return names.map(lambda n: None if n is None else str(uuid.uuid5(space, n)))

    return make
