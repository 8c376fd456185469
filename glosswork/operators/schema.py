"""JSON Schema compiled to columns over VARIANT.

A schema is known before the rows are: it is turned into one expression, with
references unrolled, so documents are checked in the JVM. The subset: $ref inside
the schema, const, enum, type, required, properties, additionalProperties, items,
minItems, maxItems, uniqueItems, minLength, maxLength, pattern, format (date,
date-time, uri), minimum, maximum, allOf, anyOf, oneOf, not.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswork.functions.text import let

_DATE = r"^([0-9]{4})-?(0[1-9]|1[0-2])-?(0[1-9]|[12][0-9]|3[01])$"
_WEEK = r"^[0-9]{4}(-?)W(0[1-9]|[1-4][0-9]|5[0-3])(\1[1-7])?$"
_TIME = r"^([01][0-9]|2[0-3])(:?[0-5][0-9](:?[0-5][0-9]([.,][0-9]+)?)?)?(Z|[+-]([01][0-9]|2[0-3])(:?[0-5][0-9](:?[0-5][0-9]([.,][0-9]+)?)?)?)?$"


def resolved(root: Mapping, reference: str) -> Mapping:
    """The part of the schema that a reference names."""
    if not reference.startswith("#/"):
        raise ValueError(f"a reference inside the schema begins with #/: {reference}")
    node: Any = root
    for name in reference[2:].split("/"):
        node = node[name.replace("~1", "/").replace("~0", "~")]
    return node


def _path(key: str) -> str:
    if "'" in key and '"' in key:
        raise ValueError(f"a key with both kinds of quotes has no path: {key}")
    return f"$[\"{key}\"]" if "'" in key else f"$['{key}']"


def _count(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _date_fits(text: Column) -> Column:
    plain = F.regexp_replace(text, "-", "")
    dashes = F.length(text) - F.length(plain)
    return text.rlike(_DATE) & dashes.isin(0, 2) & F.try_to_date(plain, "yyyyMMdd").isNotNull() | text.rlike(_WEEK)


def _fits(text: Column, kind: str) -> Column | None:
    if kind == "date":
        return _date_fits(text)
    if kind == "date-time":
        day = F.regexp_extract(text, r"(?s)^(.{10}|.{8})(?:[T ].*)?$", 1)
        rest = F.substring(text, F.length(day) + 2, F.length(text))
        return _date_fits(day) & ((F.length(text) == F.length(day)) | rest.rlike(_TIME))
    if kind == "uri":
        return text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return None  # other formats are remarks


class _Value:
    """A VARIANT value with the tests that rules ask for."""

    def __init__(self, value: Column):
        self.value, self.kind = value, F.schema_of_variant(value)

    def get(self, kind: str) -> Column:
        return F.try_variant_get(self.value, "$", kind)

    def is_kind(self, name: str) -> Column:
        k = self.kind
        number = k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL")
        tests = {
            "null": k == "VOID", "boolean": k == "BOOLEAN", "string": k == "STRING", "object": k.startswith("OBJECT"), "array": k.startswith("ARRAY"),
            # A whole number of more than 64 bits is a decimal; one written with a point isn't an integer.
            "integer": (k == "BIGINT") | k.rlike(r"^DECIMAL\([0-9]+,0\)$") & (F.abs(self.get("double")) >= 2.0**63),
            "number": number & (F.abs(self.get("double")) < float("inf")),
        }
        return tests.get(name, F.lit(True))

    def equals(self, wanted: Any) -> Column:
        if wanted is None:
            return self.is_kind("null")
        if isinstance(wanted, bool):
            # As numbers are, true is 1 and false is 0.
            return self.is_kind("boolean") & (self.get("boolean") == wanted) | self.is_kind("number") & (self.get("double") == float(wanted))
        if isinstance(wanted, (int, float)):
            same = self.is_kind("number") & (self.get("double") == float(wanted))
            return same | self.is_kind("boolean") & (self.get("boolean").cast("double") == float(wanted))
        if isinstance(wanted, str):
            return self.is_kind("string") & (self.get("string") == wanted)
        text = json.dumps(wanted, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return (self.is_kind("object") | self.is_kind("array")) & (F.to_json(self.value) == F.to_json(F.parse_json(F.lit(text))))


def _errors(value: Column, schema: Mapping, root: Mapping, seen: tuple[str, ...]) -> Column:
    v, total = _Value(value), []
    if "$ref" in schema:
        name = str(schema["$ref"])
        if name in seen:
            raise ValueError(f"a schema that refers to itself has no end when unrolled: {name}")
        total.append(_errors(value, resolved(root, name), root, (*seen, name)))
    if "const" in schema:
        total.append(_count(~v.equals(schema["const"])))
    if "enum" in schema:
        any_of = F.lit(False)
        for wanted in schema["enum"]:
            any_of = any_of | F.coalesce(v.equals(wanted), F.lit(False))
        total.append(_count(~any_of))
    rest = [*_of_object(v, schema, root, seen), *_of_array(v, schema, root, seen), *_of_scalars(v, schema)]
    for name, options in ((n, [o for o in schema.get(n, ()) if isinstance(o, Mapping)]) for n in ("allOf", "anyOf", "oneOf") if n in schema):
        met = sum((_count(_errors(value, o, root, seen) == 0) for o in options), F.lit(0))
        rest.append(_count({"allOf": met < len(options), "anyOf": met < 1, "oneOf": met != 1}[name]))
    if isinstance(schema.get("not"), Mapping):
        rest.append(_count(_errors(value, schema["not"], root, seen) == 0))
    kinds = schema.get("type")
    later = sum(rest, F.lit(0))
    if kinds is not None:
        fits = F.lit(False)
        for kind in [kinds] if isinstance(kinds, str) else kinds:
            fits = fits | F.coalesce(v.is_kind(kind), F.lit(False))
        later = F.when(fits, later).otherwise(1)  # nothing else is asked of a value of another type
    return sum(total, F.lit(0)) + later


def _of_object(v: _Value, schema: Mapping, root: Mapping, seen) -> list[Column]:
    is_object, found = v.is_kind("object"), []
    child = lambda key: F.try_variant_get(v.value, _path(key), "variant")
    only = lambda c: F.when(is_object, c).otherwise(0)
    for key in schema.get("required", ()):
        found.append(_count(is_object & child(key).isNull()))
    known = schema.get("properties", {})
    for key, rule in known.items():
        if isinstance(rule, Mapping):
            found.append(only(F.when(child(key).isNotNull(), let(child(key), lambda c, rule=rule: _errors(c, rule, root, seen))).otherwise(0)))
    more = schema.get("additionalProperties", True)
    fields = v.get("map<string,variant>")
    others = F.filter(F.map_keys(fields), lambda k: ~k.isin(*known)) if known else F.map_keys(fields)
    if more is False:
        found.append(only(F.size(others)))
    elif isinstance(more, Mapping):
        each = F.transform(others, lambda k: _errors(F.try_element_at(fields, k), more, root, seen))
        found.append(only(F.aggregate(each, F.lit(0), lambda s, x: s + x)))
    return found


def _of_array(v: _Value, schema: Mapping, root: Mapping, seen) -> list[Column]:
    items, is_array, found = v.get("array<variant>"), v.is_kind("array"), []
    if isinstance(schema.get("minItems"), int):
        found.append(_count(is_array & (F.size(items) < schema["minItems"])))
    if isinstance(schema.get("maxItems"), int):
        found.append(_count(is_array & (F.size(items) > schema["maxItems"])))
    if schema.get("uniqueItems") is True:
        texts = F.transform(items, lambda x: F.concat(F.schema_of_variant(x).substr(1, 1), F.coalesce(F.to_json(x), F.lit("null"))))
        found.append(_count(is_array & (F.size(F.array_distinct(texts)) < F.size(items))))
    if isinstance(schema.get("items"), Mapping):
        each = F.transform(items, lambda x: _errors(x, schema["items"], root, seen))
        found.append(F.when(is_array, F.aggregate(each, F.lit(0), lambda s, x: s + x)).otherwise(0))
    return found


def _of_scalars(v: _Value, schema: Mapping) -> list[Column]:
    found, text, number = [], v.get("string"), v.get("double")
    is_text, is_number = v.is_kind("string"), v.is_kind("number")
    for name, test in (("minLength", lambda n: F.length(text) < n), ("maxLength", lambda n: F.length(text) > n)):
        if isinstance(schema.get(name), int):
            found.append(_count(is_text & test(schema[name])))
    if isinstance(schema.get("pattern"), str):
        found.append(_count(is_text & ~text.rlike(schema["pattern"])))
    if isinstance(schema.get("format"), str) and (fits := _fits(text, schema["format"])) is not None:
        found.append(_count(is_text & ~fits))
    for name, test in (("minimum", lambda n: number < n), ("maximum", lambda n: number > n)):
        if isinstance(schema.get(name), (int, float)):
            found.append(_count(is_number & test(float(schema[name]))))
    return found


def violations(schema: Mapping, text: Column) -> Column:
    """Number of violations of a schema in JSON text; null for text that is no JSON
    (NaN, Infinity and repeated keys included).

    A type that doesn't fit counts once and ends the checks of that value;
    allOf, anyOf, oneOf and not count once each.
    """
    return let(F.try_parse_json(text), lambda v: F.when(v.isNotNull(), _errors(v, schema, schema, ())))
