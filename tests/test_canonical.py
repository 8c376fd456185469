"""Canonical JSON against json.dumps over nested records."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from glosswork.functions import canonical as C

KINDS = "a struct<z: int, b: array<struct<y: string, x: double>>>, m map<string, array<map<string, boolean>>>, s array<array<int>>, d date, t timestamp, n timestamp_ntz, q decimal(10,2)"


def dumps(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def record(rng):
    word = lambda: rng.choice(["", "é😀", 'q"\\/', "\n\t\r\b\f\x00\x1f\x7f", " ", "plain", None])
    number = lambda: rng.choice([0.0, -0.0, 1.5, 1e-4, 1.25e-7, 1e7, 123456789.25, 1e15, 1e16, -2.5e22, 1e100, 0.1, 1 / 3, None])
    b = rng.choice([None, [], [(word(), number()) for _ in range(3)], [None]])
    m = rng.choice([None, {}, {"b": [{"y": True, "x": None}], "a": None, "é": []}])
    s = rng.choice([None, [[2, 1], None, [1]], [[3], [1, 2]]])
    t = rng.choice([None, dt.datetime(2020, 1, 2, 3, 4, 5), dt.datetime(1999, 12, 31, 23, 59, 59, 120)])
    return (rng.choice([None, (rng.randrange(9), b)]), m, s, rng.choice([None, dt.date(2020, 2, 29)]), t, t)


def plain(row, sets):
    a, m, s, d, t, n = row
    iso = lambda x, z: None if x is None else x.isoformat() + z
    inner = None if a is None else {"z": a[0], "b": None if a[1] is None else [None if x is None else {"y": x[0], "x": x[1]} for x in a[1]]}
    if sets and s is not None:
        # Sorted as text, inner arrays too.
        s = [x if x is None else [int(i) for i in sorted(map(str, x))] for x in s]
        s = [json.loads(x) for x in sorted(map(dumps, s))]
    return {"a": inner, "m": m, "s": s, "d": None if d is None else d.isoformat(), "t": iso(t, "Z"), "n": iso(n, ""), "q": None}


@pytest.mark.parametrize("sets", [(), ("s",)])
def test_nested(spark, sets):
    rng = random.Random(3)
    rows = [record(rng) for _ in range(300)]
    data = [(*r[:4], None if r[4] is None else r[4].replace(tzinfo=dt.timezone.utc), r[5], None) for r in rows]
    df = spark.createDataFrame(data, KINDS)
    got = [r[0] for r in df.select(C.canonical_json(F.struct(*df.columns), df.schema, sets)).collect()]
    assert got == [dumps(plain(r, sets)) for r in rows]


def test_numbers(spark):
    rng = random.Random(4)
    values = [round(rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 20), rng.randrange(3)) for _ in range(500)] + [10.0**e for e in range(-30, 30)] + [rng.randrange(1, 9999) * 2.0**-e for e in range(12)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(C.number_text(F.col("v"))).collect()] == [repr(v) for v in values]
    for bad in ("NaN", "Infinity"):
        with pytest.raises(Exception, match="no NaN"):
            spark.sql(f"select double('{bad}') v").select(C.number_text(F.col("v"))).collect()


def test_seal(spark):
    df = spark.createDataFrame([(1, ["b", "a"], 2.5), (2, None, None)], "k int, names array<string>, v double")
    kept = C.sealed(df, sets=["names"])
    assert all(r.ok for r in kept.select(C.seal_holds(kept, sets=["names"]).alias("ok")).collect())
    other = kept.withColumn("names", F.reverse("names"))
    assert all(r.ok for r in other.select(C.seal_holds(other, sets=["names"]).alias("ok")).collect())
    changed = kept.withColumn("v", F.lit(9.0))
    assert not any(r.ok for r in changed.select(C.seal_holds(changed, sets=["names"]).alias("ok")).collect())
    with pytest.raises(TypeError):
        C.canonical_json(F.lit(b"x"), spark.sql("select binary('x') b").schema["b"].dataType)
