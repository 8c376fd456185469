"""Facts of many decrees: dealt over tasks, and normal forms that don't try every mark at every character."""

import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from glosswork.functions import decrees as D
from glosswork.functions import text as T
from glosswork.operators import evaluation as E
from glosswork.plans import QUERIES

LAW = "MINISTERIO DE ECONOMÍA\nDecreto N° 12/2021\nApruébase el programa.\nBuenos Aires, 3/5/2021\nEL PRESIDENTE DECRETA:\n" + "".join(f"Artículo {i} — Autorízase el gasto {i} del programa.\n" for i in range(1, 12))


@pytest.mark.parametrize("name", ["x13_reference_facts"])
def test_rows_are_dealt_before_they_grow(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_facts_of_long_lines(spark):
    """Shouted lines, blanks of any script, articles and critical terms."""
    text = "A1B2C3 D4E5F6G7H8I9J\nÁÉÍÓÚÜÑÁÉÍ\nABCDEFGHIj\n a  b 　c  d\nDECRETA\nArtículo 1 — ANEXOS y anexo\nArtículo 2 — ANEXO I\nart. 3 xArtículo 4 cese"
    rows = spark.createDataFrame([(text,)], "t string").select(D.reference_facts(F.col("t")).alias("all"), D.reference_facts(F.col("t"), critical=False).alias("some")).first()
    got = {f.fact_id: f.text for f in rows["all"]}
    assert [v for k, v in got.items() if k.startswith("dependencia")] == ["A1B2C3 D4E5F6G7H8I9J"]
    assert got["articulo-1"] == "ANEXOS y anexo" or got["articulo-1"] == "ANEXOS y"
    assert got["articulo-3"] == "xArtículo 4 cese" and "articulo-2" not in got and "articulo-4" not in got
    assert [f for f in rows["all"] if f.field != "datos_criticos"] == rows["some"] and len(rows["some"]) < len(rows["all"])


def test_classes_hold_what_they_held(spark):
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c,) for c in chars], "c string")
    marks = {r.c for r in rows.where(F.col("c").rlike(T.COMBINING)).collect()}
    assert marks == {c for c in chars if (0x300 <= ord(c) < 0x3100 or 0xFE20 <= ord(c) < 0xFE30) and all(map(unicodedata.combining, unicodedata.normalize("NFKD", c)))}
    assert {r.c for r in rows.where(F.col("c").rlike(T._class("".join(T.JOINED)))).collect()} == set(T.JOINED)
    assert {r.c for r in rows.where(F.col("c").rlike(D.BLANK)).collect()} == {r.c for r in rows.where(F.col("c").rlike(r"(?U)\s")).collect()}


def test_coverage_of_many_decrees_in_one_task(spark):
    cases = spark.range(2_000).repartition(1).select("id", F.concat(F.lit(LAW), F.col("id")).alias("gold"), F.lit(LAW).alias("draft"))
    began = time.time()
    got = E.reference_coverage(cases, "id", "gold", "draft").groupBy("covered").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) >= 2_000 * 15 and time.time() - began < 15
