"""Normal forms against unicodedata, over letters of many alphabets."""

import re
import unicodedata

from pyspark.sql import functions as F

from glosswork.functions import text as T

TEXTS = [
    "Škoda žluťoučký ő ű Ł đ ø", "été ñ Å", "ﬁn ﬂow ĳs ǅ ½ kg", "Ａｂｃ１２ ① x² Hº 1ª", "Ünïcödé ÀÉÎÕÜ ñ Ñ ç", "ΑΣ Ελλάς Привет 日本 한국", "ộ ế ữ", "plain text 12", "", "İstanbul ı",
]


def nfkd(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", plain.lower()).strip(" ")


def test_comparison_form(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = df.select("i", T.comparison_form(F.col("t")).alias("a"), T.comparison_form(F.col("t"), exact=True).alias("b")).collect()
    assert {r.i: r.a for r in rows} == {r.i: r.b for r in rows} == {i: nfkd(t) for i, t in enumerate(TEXTS)}


def test_every_letter(spark):
    """All code points up to U+3000 and the full-width forms, one a row, between letters."""
    codes = [c for c in [*range(0x20, 0x3000), *range(0xFF01, 0xFF5F)] if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    df = spark.createDataFrame([(c, f"a{chr(c)}b") for c in codes], "c int, t string")
    got = {r.c: r.a for r in df.select("c", T.comparison_form(F.col("t")).alias("a")).collect()}
    wrong = [c for c in codes if got[c] != nfkd(f"a{chr(c)}b")]
    # Single characters for several letters are in the table of JOINED or need exact=True.
    # One character that stands for several letters is in the table of JOINED or needs exact=True.
    several = [c for c in wrong if sum(not unicodedata.combining(x) for x in unicodedata.normalize("NFKD", chr(c))) > 1]
    assert wrong == several and all(c > 0x1000 for c in wrong)


def test_strip_accents(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:6])], "i int, t string")
    for r in df.select("i", T.strip_accents(F.col("t")).alias("a")).collect():
        if r.i in (0, 1, 4):
            assert r.a == "".join(c for c in unicodedata.normalize("NFD", TEXTS[r.i]) if not unicodedata.combining(c))


def test_faithfulness_tokens(spark):
    df = spark.createDataFrame([("El Présidente y la\0Ley de 2020, según THE ακρόπολη",)], "t string")
    assert df.select(T.faithfulness_tokens(F.col("t"))).first()[0] == ["presidente", "ley", "2020", "ακροπολη"]


def test_corpus_form_is_composed(spark):
    df = spark.createDataFrame([("été\r\nx",)], "t string")
    assert df.select(T.normalize_corpus(F.col("t"))["content"]).first()[0] == "été\nx"
