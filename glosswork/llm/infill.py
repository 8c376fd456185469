"""Fill-in-the-middle: a text cut at two ranks of units, reordered with marks.

A unit is a code point, a word with the white space after it, or a line; where
one unit ends and the next begins is a predicate on two adjacent characters.
Texts of a block are cut into chunks that overlap by one character, so every
adjacent pair lies in one chunk. Boundaries are counted per chunk, all chunks of
the block at once; prefix sums over the counts give the chunk that owns each of
the two cut ranks, and only those chunks are looked at again for the place. A
block holds about a million characters, a longer text is a block of its own.

The ranks and the form of a document come from the SHA-256 of "1:" and its id,
so they don't depend on partitions or order.

Defined cases: null text counts as empty; an empty text and one that holds a mark
are plain (left as they are), as is a share of all; a null id hashes as "1:";
rows that repeat an id are cut alike; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import ROOT, table, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 4096
BLOCK = 1 << 20


def boundaries(left, right, unit: str):
    """Whether a unit ends between the characters left and right (arrays of code points)."""
    import numpy as np

    def white(x):
        return (x == 32) | ((x >= 9) & (x <= 13))

    if unit == "char":
        return np.ones(len(left), bool)
    if unit == "word":
        return white(left) & ~white(right)
    if unit == "line":
        return left == 10
    raise ValueError(f"unit is char, word or line, not {unit!r}")


class Chunks:
    """Chunks of a block of texts with their counts of boundaries."""

    def __init__(self, texts: list[str], unit: str, size: int = CHUNK):
        import numpy as np

        self.codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        self.unit, self.size = unit, size
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.lengths) - self.lengths
        #: A text of n characters has n - 1 adjacent pairs.
        self.many = -(-np.maximum(self.lengths - 1, 0) // size)
        self.first = np.cumsum(self.many) - self.many
        owner = np.repeat(np.arange(len(texts)), self.many)
        within = np.arange(len(owner)) - self.first[owner]
        self.left = self.starts[owner] + within * size
        self.right = np.minimum(self.left + size, self.starts[owner] + self.lengths[owner] - 1)
        if not len(self.codes) or not len(owner):
            counts = np.zeros(len(owner), np.int64)
        else:
            flags = boundaries(self.codes[:-1], self.codes[1:], unit).astype(np.int64)
            counts = np.add.reduceat(np.append(flags, 0), np.stack([self.left, self.right], 1).ravel())[::2]
        #: Boundaries in the chunks before, over the whole block.
        self.before = np.append(0, np.cumsum(counts))

    def units(self):
        """Number of units of each text."""
        inside = self.before[self.first + self.many] - self.before[self.first]
        return inside + (self.lengths > 0)

    def place(self, text: int, rank: int) -> int:
        """Where the first rank units of a text end, in characters."""
        import numpy as np

        if rank <= 0:
            return 0
        lo, hi = int(self.first[text]), int(self.first[text] + self.many[text])
        wanted = int(self.before[lo]) + rank
        if wanted > self.before[hi]:
            return int(self.lengths[text])
        chunk = int(np.searchsorted(self.before[lo : hi + 1], wanted)) + lo - 1
        a, b = int(self.left[chunk]), int(self.right[chunk])
        found = np.flatnonzero(boundaries(self.codes[a:b], self.codes[a + 1 : b + 1], self.unit))
        return a + int(found[wanted - int(self.before[chunk]) - 1]) + 1 - int(self.starts[text])


def arrange(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "plain":
        return prefix + middle + suffix
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restore(output: str, form: str) -> str:
    """The text that arrange() was given; its parts hold no mark unless form is plain."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def _blocks(texts: list[str]):
    """Ranges of rows that hold about BLOCK characters."""
    at = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > BLOCK:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)


OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string"


def fill_in_middle(docs: DataFrame, unit: str = "char", plain_percent: int = 10, spm_percent: int = 20, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: doc_id, n (units), form (plain, psm or spm), the
    characters of prefix and middle (null if plain), output and the text restored from it."""
    root = ROOT

    def run(batches):
        import sys

        import pyarrow as pa

        if root not in sys.path:
            sys.path.append(root)
        from glosswork.llm.infill import MIDDLE, PREFIX, SUFFIX, Chunks, _blocks, arrange, restore

        schema = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (x.split() for x in OUT.split(", "))])
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            hashes = batch.column("hashes").to_pylist()
            for a, b in _blocks(texts):
                some = Chunks(texts[a:b], unit, chunk)
                rows = []
                for k, n in enumerate(some.units().tolist()):
                    text, (h1, h2, h3, h4) = texts[a + k], hashes[a + k]
                    form = "psm" if h4 % 100 >= spm_percent else "spm"
                    if not text or h3 % 100 >= 100 - plain_percent or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                        rows.append((ids[a + k], n, "plain", None, None, text, text))
                        continue
                    cut, end = (some.place(k, r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
                    output = arrange(form, text[:cut], text[cut:end], text[end:])
                    rows.append((ids[a + k], n, form, cut, end - cut, output, restore(output, form)))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashes = F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))
    return text_of(docs).withColumn("hashes", hashes).mapInArrow(run, OUT)


def query(spark, sf_dir):
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
r AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
         CASE WHEN n = 0 OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%'
                OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, substr(text, 1, least(a, b)) AS prefix, substr(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle,
         substr(text, greatest(a, b) + 1) AS suffix
  FROM r)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
