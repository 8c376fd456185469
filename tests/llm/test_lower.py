"""Lower-casing of A-Z alone, which op3 runs over every text several times."""

import sys

from pyspark.sql import functions as F

from glosswork.llm import exact_dedup
from glosswork.llm.common import LOWER, UPPER, lower_az


def test_lower_az_on_every_character(spark):
    points = [i for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    texts = ["".join(map(chr, points[at : at + 4096])) for at in range(0, len(points), 4096)] + [UPPER, "", "É" + UPPER, UPPER + "ß"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    table = str.maketrans(UPPER, LOWER)
    assert all(r.low == r.text.translate(table) for r in rows.select("text", lower_az(F.col("text")).alias("low")).collect())


def test_op3_has_no_regular_expression(spark, docs):
    """One over whole texts took more time than all else in op3 together."""
    for df in (exact_dedup.content_sort(docs), exact_dedup.keep_one(docs)):
        assert "RLIKE" not in df._jdf.queryExecution().toString().upper()
