"""Run folders, their sidecars and the content-addressed store."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from glosswork.sources import cases as K


@pytest.fixture()
def run(spark, tmp_path):
    df = spark.range(1, 31).selectExpr("cast(id as int) as case_number", "to_json(struct(id as case_number, id * 2 as v, 'é' as t)) as payload").repartition(4)
    K.write_run(df, str(tmp_path / "run"), {"model": "m", "año": 1})
    return str(tmp_path / "run")


def test_read_and_filters(spark, run):
    rows = K.read_run(spark, run, expected=30, per_task=4).collect()
    assert sorted(r.case_number for r in rows) == list(range(1, 31))
    assert all(json.loads(r.payload)["v"] == 2 * r.case_number for r in rows)
    for test, want in (("case_number = 7", {7}), ("case_number > 28", {29, 30}), ("case_number between 3 and 4", {3, 4}), ("case_number in (1, 5, 99)", {1, 5}), ("case_number >= 30 or case_number < 2", {1, 30})):
        assert {r.case_number for r in K.read_run(spark, run).where(test).collect()} == want
    assert K.read_sidecar(run) == {"model": "m", "año": 1, "cases": 30}


def test_filters_decide_what_is_opened(spark, run):
    open(f"{run}/case-0009.json", "w").write("{broken")
    assert K.read_run(spark, run).where("case_number < 9").count() == 8
    with pytest.raises(Exception, match="JSON|Expecting"):
        K.read_run(spark, run).collect()


def test_refusals(spark, run):
    open(f"{run}/case-0031.json", "w").write('{"case_number": 5}')
    with pytest.raises(Exception, match="holds case 5"):
        K.read_run(spark, run).collect()
    with pytest.raises(Exception, match="out of 1 to 30"):
        K.read_run(spark, run, expected=30).collect()
    text = open(f"{run}/metadata.json").read()
    open(f"{run}/metadata.json", "w").write(text.replace('"m"', '"other"'))
    with pytest.raises(Exception, match="not that of its metadata"):
        K.read_run(spark, run).collect()
    for bad in ("[]", '{"metadata": 1}'):
        with pytest.raises(ValueError):
            K.checked(bad, "x")


def test_empty_run(spark, tmp_path):
    K.write_run(spark.createDataFrame([], "case_number int, payload string"), str(tmp_path / "none"), {})
    assert K.read_run(spark, str(tmp_path / "none")).collect() == []
    assert K.read_sidecar(str(tmp_path)) == {}


def test_cache(spark, tmp_path):
    cache, calls = K.Cache(spark, str(tmp_path / "cache")), []

    def double(df):
        calls.append(1)
        return df.select((F.col("id") * 2).alias("v"))

    a = spark.range(50)
    for df in (a, a.repartition(7), a.orderBy(F.desc("id"))):
        assert sorted(r.v for r in cache.get("double", {"k": 1}, [df], double).collect()) == list(range(0, 100, 2))
    assert (cache.hits, cache.misses, len(calls)) == (2, 1, 1)
    cache.get("double", {"k": 2}, [a], double)
    cache.get("double", {"k": 1}, [spark.range(51)], double)
    cache.get("double", {"k": 1}, [a.union(spark.range(1))], double)
    assert (cache.hits, cache.misses) == (2, 4)


def test_cache_race(spark, tmp_path):
    """Of two that compute the same at once one result stands, whole."""
    cache, gate, seen = K.Cache(spark, str(tmp_path / "race")), threading.Barrier(2), []

    def slow(df):
        gate.wait(60)
        return df

    def work():
        seen.append(cache.get("same", {}, [spark.range(20)], slow).count())

    threads = [threading.Thread(target=work) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert seen == [20, 20] and cache.misses == 2
    assert [p for p in (tmp_path / "race").iterdir() if not p.name.startswith(".")].__len__() == 1
