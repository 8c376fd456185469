"""Polarity against its SQL on words beside letters beyond ASCII."""

import duckdb
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.plans import ORACLES, QUERIES

TEXTS = ["Noñas", "ñno", "sinó", "no", "NO!", "nota", "JAMÁS", "jamás_", "ésin é", "pro\u0301no\u0301", "\u017fin", "a\u017fin", "prohibida\u017f", "x\u00adno", "9no", "", None]


def test_same_as_sql_beside_any_letter(spark, tmp_path):
    rows = [(i, 1, "user", t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = QUERIES["x06_polarity"](spark, str(tmp_path)).select("conv_id", "turn", "polarity").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLES["x06_polarity"]).fetchall())


def test_words_of_any_letters_stay_whole(spark):
    rows = spark.createDataFrame([(t,) for t in ("Noñas", "ñno", "no")], "t string").select(T.polarity(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["AFFIRMED", "AFFIRMED", "NEGATED"]
