"""Inventories, manifests and merged documents case by case."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from glosswork.functions import identity
from glosswork.operators import inventory as I
from glosswork.sources.files import safe_identifier


def test_run_inventory(spark):
    manifest = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "case int, digest string")
    cases = [("full", c, d, True) for c, d in ((1, "a"), (2, "b"), (3, "c"))] + [("part", 1, "a", False)]
    cases += [("bad", 1, "a", True), ("bad", 1, "a", True), ("bad", 2, "other", True), ("bad", 9, "z", True), ("bad", 3, None, True)]
    reported = [("full", 3, 3), ("part", 1, 1), ("gone", 2, 0)]
    got = {r.run: r for r in I.run_inventory(spark.createDataFrame(cases, "run string, case int, digest string, passed boolean"), manifest, spark.createDataFrame(reported, "run string, total int, passed int")).collect()}
    assert (got["full"].integrity, got["full"].worst, got["full"].findings) == ("FULL", "OK", [])
    assert (got["part"].integrity, got["part"].missing, [f.code for f in got["part"].findings]) == ("PARTIAL", 2, ["REPORT_DISAGREES", "MISSING_CASES", "FAILED_CASES"])
    bad = got["bad"]
    assert (bad.integrity, bad.worst, bad.present, bad.unexpected, bad.duplicates, bad.mismatched) == ("INVALID", "BLOCK", 3, 1, 1, 1)
    assert [f.code for f in bad.findings] == ["UNEXPECTED_CASES", "DIGEST_MISMATCH", "DUPLICATE_CASES", "NOT_REPORTED"]
    assert (got["gone"].present, got["gone"].missing, got["gone"].reported_total) == (0, 3, 2)


HEX = {c: c * 64 for c in "abcdef"}
MANIFEST = [
    ("ok", "x/1.txt", HEX["a"], "e", [], "OK"), ("twice", "2", HEX["b"], "e", [], "CASE_INVALID"), ("twice", "3", HEX["c"], "e", None, "CASE_INVALID"), ("upper", "4", "A" * 64, "e", [], "CASE_INVALID"),
    ("blank", "5", HEX["d"], "e", [" "], "CASE_INVALID"), (None, "6", "1" * 64, "e", [], "CASE_INVALID"), ("climbs", "x/../../7", "2" * 64, "e", ["y"], "PATH_INVALID"), ("root", "/etc/8", "3" * 64, "e", [], "PATH_INVALID"),
    ("gone", "9", "4" * 64, "e", [], "FILE_MISSING"), ("changed", "10", "5" * 64, "e", [], "HASH_MISMATCH"), ("same1", "11", HEX["e"], "e", [], "CASE_INVALID"), ("same2", "12", HEX["e"], "e", [], "CASE_INVALID"), ("noid", "13", "6" * 64, None, [], "CASE_INVALID"),
]


def test_manifest(spark):
    cases = spark.createDataFrame([m[:5] for m in MANIFEST], "case_id string, relative_path string, sha256 string, external_id string, expected array<string>")
    files = spark.createDataFrame([("x/1.txt", HEX["a"]), ("10", "0" * 64), ("x/../../7", "2" * 64)], "path string, sha256 string")
    header = {"split": "HELD", "dataset_version": "1", "source": "s"}
    got = {(r.case_id, r.relative_path): r.code for r in I.checked_manifest(header, cases, files, "HELD").collect()}
    assert got == {m[:2]: m[5] for m in MANIFEST}
    for broken in ({**header, "split": "ALL"}, {**header, "source": ""}, {}):
        with pytest.raises(ValueError):
            I.checked_manifest(broken, cases, files, "HELD")


BAD, ID = "CORPUS_JSON_SCHEMA_INVALID", "CORPUS_SOURCE_IDENTIFIER_INVALID"
DOCUMENTS = [
    ({"content": "x", "metadata": {"a": 1, "b": [1, "z"]}, "external_id": 'q"1'}, None, {"a": "1", "b": '[1,"z"]', "external_id": '"q\\"1"'}),
    ({"text": "x"}, None, {}), ({"content": " ", "text": "x"}, BAD, None), ({"content": 3, "text": "x"}, BAD, None), ({"content": "x", "more": 1}, BAD, None), ([1], BAD, None),
    ({"content": "x", "metadata": []}, BAD, None), ({"content": "x", "external_id": 3}, BAD, None), ({"content": "x", "external_id": " "}, BAD, None), ({}, BAD, None),
    ({"content": "x", "external_id": "a", "metadata": {"external_id": "a"}}, None, {"external_id": '"a"'}), ({"content": "x", "external_id": "a", "metadata": {"external_id": "b"}}, BAD, None),
    ({"content": "x", "source_identifier": "a//b\\c"}, None, {"source_identifier": '"a/b/c"'}), ({"content": "x", "source_identifier": "../b"}, ID, None),
    ({"content": "x", "source_identifier": "a", "metadata": {"source_identifier": "b"}}, BAD, None), ({"content": "x", "source_identifier": None}, BAD, None), ({"content": "x", "metadata": {"external_id": None}}, None, {"external_id": "null"}),
]


def test_merged_documents(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _, _) in enumerate(DOCUMENTS)] + [(98, "{bad"), (99, None)], "i int, t string")
    got = {r.i: r.m for r in df.select("i", I.merged_document(F.col("t"), safe_identifier).alias("m")).collect()}
    for i, (doc, error, metadata) in enumerate(DOCUMENTS):
        assert (got[i].error, got[i].metadata) == (error, metadata), doc
        assert got[i].content == (None if error else doc.get("content", doc.get("text")))
    assert got[98].error == got[99].error == "CORPUS_PARSE_FAILED"


def test_aged_orphans(spark):
    now = dt.datetime(2020, 6, 1)
    files = spark.createDataFrame([("tmp-1", dt.datetime(2020, 1, 1)), ("a", dt.datetime(2020, 1, 1)), ("b", dt.datetime(2020, 5, 31)), ("c", None), ("kept", now), ("edge", dt.datetime(2020, 5, 2))], "path string, at timestamp")
    known = spark.createDataFrame([("kept",), ("lost",)], "path string")
    got = {r.path: r.finding for r in I.aged_orphans(files, known, "path", "at", F.lit(now), F.expr("interval 30 days")).collect()}
    assert got == {"tmp-1": "TEMPORARY", "a": "ORPHAN", "b": "RECENT", "c": "RECENT", "lost": "MISSING", "edge": "ORPHAN"}


def test_identity(spark):
    rows = [("DNI", " 123 "), ("DNI", "12a"), ("LC", "ab1"), ("PASSPORT", "A-1"), ("X", "1"), ("DNI", "  ")]
    df = spark.createDataFrame(rows, "k string, v string")
    assert [r[0] for r in df.select(identity.document_number(F.col("k"), F.col("v"))).collect()] == ["123", None, "AB1", None, None, None]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(identity.tax_number(F.lit(" 20-12345678 9"))) == "20123456789" and one(identity.tax_number(F.lit("20-1234"))) is None
    assert one(identity.phone(F.lit(" +54 11 4 "))) == "+54114" and one(identity.email(F.lit(" A@B.C\n"))) == "a@b.c"
