"""Fields of texts with long runs, many texts, and patterns beside those of the SQL."""

import random
import re
import time

import duckdb
from pyspark.sql import functions as F

from glosswork.plans import ORACLES, QUERIES
from glosswork.plans import evaluators as V


def same(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    got = QUERIES["e03_text_fields"](spark, str(folder)).select("doc_id", "field", "status", "tp", "accuracy").collect()
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got) == order(con.execute(ORACLES["e03_text_fields"]).fetchall())


def test_same_as_sql_on_odd_texts(spark, tmp_path):
    rng = random.Random(6)
    parts = ["a@b", "_c@d", "-", ".", "@", "1", "23", "4567", "1.2.3", ".4", "x", " ", "\n", "\n", "É@b", "A@B", "a_b.c@d-e.f"]
    same(spark, tmp_path, ["", "\n", *("".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(400))])


def test_patterns_find_what_those_of_the_sql_find(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices("ab@@._-1234.. \n", k=rng.randrange(30))) for _ in range(5000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, pattern in V.TEXT_FIELDS.items():
        got = rows.select("t", F.regexp_extract_all("t", F.lit(V._TEXT_PATTERNS[name]), F.lit(0)).alias("m")).collect()
        assert all(r.m == re.findall(pattern, r.t) for r in got)


def test_long_runs_and_many_texts(spark, tmp_path):
    """A run was tried anew from each of its characters, and fields were taken from a text for each use of them."""
    texts = ["a" * 200_000 + "@", "1" * 200_000, "@" + "a-" * 100_000, "1." * 50_000, *("palabra 12345 a@b.c 1.2.3\n" * 60 for _ in range(1000))]
    began = time.time()
    same(spark, tmp_path, texts)
    assert time.time() - began < 30
