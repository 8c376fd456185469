"""Compiled schemas against a plain validator, on random documents and schemas."""

import datetime
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from glosswork.operators import schema as S

KINDS = {"null": type(None), "boolean": bool, "object": dict, "array": list, "string": str}


def is_kind(v, kind):
    if kind in ("integer", "number"):
        return isinstance(v, int if kind == "integer" else (int, float)) and not isinstance(v, bool)
    return isinstance(v, KINDS[kind])


def fits(v, kind):
    try:
        if kind == "date":
            datetime.date.fromisoformat(v)
        if kind == "date-time":
            datetime.datetime.fromisoformat(v.replace("Z", "+00:00"))
    except ValueError:
        return False
    return kind != "uri" or bool(re.match("[A-Za-z][A-Za-z0-9+.-]*:", v))


def count(v, s, root):
    n = count(v, S.resolved(root, s["$ref"]), root) if "$ref" in s else 0
    n += ("const" in s and v != s["const"]) + ("enum" in s and v not in s["enum"])
    kinds = s.get("type")
    if kinds and not any(is_kind(v, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return n + 1
    if isinstance(v, dict):
        known, more = s.get("properties", {}), s.get("additionalProperties", True)
        n += sum(k not in v for k in s.get("required", ())) + sum(count(v[k], r, root) for k, r in known.items() if k in v)
        others = [k for k in v if k not in known]
        n += len(others) if more is False else sum(count(v[k], more, root) for k in others) if isinstance(more, dict) else 0
    if isinstance(v, list):
        n += (len(v) < s.get("minItems", 0)) + (len(v) > s.get("maxItems", len(v)))
        n += bool(s.get("uniqueItems")) and len({json.dumps(x, sort_keys=True) for x in v}) < len(v)
        n += sum(count(x, s["items"], root) for x in v) if "items" in s else 0
    if isinstance(v, str):
        n += (len(v) < s.get("minLength", 0)) + (len(v) > s.get("maxLength", len(v)))
        n += ("pattern" in s and not re.search(s["pattern"], v)) + ("format" in s and not fits(v, s["format"]))
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        n += (v < s.get("minimum", v)) + (v > s.get("maximum", v))
    good = lambda name: sum(count(v, o, root) == 0 for o in s[name])
    n += ("allOf" in s and good("allOf") < len(s["allOf"])) + ("anyOf" in s and good("anyOf") < 1) + ("oneOf" in s and good("oneOf") != 1)
    return n + ("not" in s and count(v, s["not"], root) == 0)


def value(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind > 6:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 6:
        return {rng.choice("abcd"): value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return rng.choice([None, True, False, 0, 1, 7, -3, 2.5, "", "a", "abc", "é😀", "2020-01-31", "x:y", "x y"])


SCHEMAS = [
    {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer", "minimum": 0, "maximum": 5}, "b": {"$ref": "#/$defs/x~1y"}}, "additionalProperties": False, "$defs": {"x/y": {"type": ["string", "null"], "maxLength": 2}}},
    {"type": "array", "items": {"type": ["number", "string"], "minimum": 1}, "minItems": 1, "maxItems": 2, "uniqueItems": True},
    {"anyOf": [{"type": "string", "minLength": 2}, {"type": "number"}], "not": {"const": 7}},
    {"oneOf": [{"type": "integer"}, {"type": "number", "maximum": 2}], "allOf": [{"enum": [1, "a", None, 2.5, True]}, {"not": {"type": "null"}}]},
    {"properties": {"a": {"items": {"properties": {"b": {"const": {"a": 1}}}, "additionalProperties": {"type": "string", "pattern": "^a"}}}}, "additionalProperties": {"type": "array"}},
    {"enum": [[1, "a"], {"a": None}, "abc", 0]},
    {},
]


@pytest.mark.parametrize("i", range(len(SCHEMAS)))
def test_random_documents(spark, i):
    rng = random.Random(i)
    rows = [(k, json.dumps(value(rng, 3))) for k in range(600)]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {r.k: r.n for r in df.select("k", S.violations(SCHEMAS[i], F.col("t")).alias("n")).collect()}
    for k, text in rows:
        assert got[k] == count(json.loads(text), SCHEMAS[i], SCHEMAS[i]), text


DATES = ["2020-02-29", "2021-02-29", "20200131", "2020-1-1", "2020-13-01", "2020-W01-1", "2020-W01", "", "x", "2020-01-01T10:00:00Z", "2020-01-01 10:00", "2020-01-01T25:00", "2020-01-01T10:00:00+02:00", "2020-01-01T", "20200101T101010", "2020-01-01T10:00:00.123"]


@pytest.mark.parametrize("kind", ["date", "date-time", "uri", "other"])
def test_formats(spark, kind):
    texts = DATES + ["http://x", "a b:c", "mailto:x", "/path"]
    df = spark.createDataFrame([(t, json.dumps(t)) for t in texts], "t string, j string")
    got = {r.t: r.n == 0 for r in df.select("t", S.violations({"format": kind}, F.col("j")).alias("n")).collect()}
    assert got == {t: fits(t, kind) for t in texts}


def test_bad_text_and_schema(spark):
    df = spark.createDataFrame([("{bad",), ("NaN",), (None,), ('{"a":1,"a":2}',), ("1.0",), ("12345678901234567890123",)], "t string")
    got = [r.n for r in df.select(S.violations({"type": "integer"}, F.col("t")).alias("n")).collect()]
    assert got == [None, None, None, None, 1, 0]
    with pytest.raises(ValueError):
        S.violations({"$ref": "#/a", "a": {"items": {"$ref": "#/a"}}}, F.lit("1"))
    assert "Python" not in df.select(S.violations(SCHEMAS[0], F.col("t")).alias("n"))._jdf.queryExecution().executedPlan().toString()
