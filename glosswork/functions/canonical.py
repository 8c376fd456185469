"""Canonical JSON of columns of any nesting, as an expression built from their type.

Objects and maps have their keys in order, sets their elements; text is escaped
as little as JSON allows; times are ISO, instants in UTC with a Z; numbers are
written as the shortest text of the JVM, in plain digits from 1e-4 to 1e16 and
else with an exponent of two digits. NaN and infinities are refused with an
error, since JSON has none.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as P

from glosswork.functions.text import let

#: Characters that JSON text escapes with a letter.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
CONTROLS = [c for c in map(chr, range(32)) if c not in ESCAPES]


def quoted(text: Column) -> Column:
    """Text as a JSON string."""
    out = text
    for char, escaped in ESCAPES.items():
        out = F.replace(out, F.lit(char), F.lit(escaped))
    rare = out
    for char in CONTROLS:
        rare = F.replace(rare, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    out = F.when(text.rlike(r"[\x00-\x07\x0B\x0E-\x1F]"), rare).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def number_text(value: Column) -> Column:
    """A double as text: 1.0, 0.001, 123456789.25, 1e+16, 1.5e-07."""
    wide = value.cast("double")
    shown = wide.cast("string")

    def written(s):
        part = lambda i: F.regexp_extract(s, r"^(-?)([0-9])\.([0-9]+)E(-?[0-9]+)$", i)
        sign, exponent = part(1), part(4).cast("int")
        digits = F.concat(part(2), F.when(part(3) == "0", "").otherwise(part(3)))
        point = exponent + 1
        left = F.rpad(F.substring(digits, 1, 40), F.greatest(point, F.length(digits)), "0")
        plain = F.concat(F.substr(left, F.lit(1), point), F.lit("."), F.coalesce(F.nullif(F.substr(left, point + 1, F.lit(40)), F.lit("")), F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(F.lit(0), -exponent - 1)), digits)
        mark = F.when(exponent < 0, "-").otherwise("+")
        tail = F.concat(F.lit("e"), mark, F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"))
        short = F.concat(part(2), F.when(F.length(digits) > 1, F.concat(F.lit("."), part(3))).otherwise(""), tail)
        form = F.when(exponent.between(0, 15), plain).when(exponent.between(-4, -1), small).otherwise(short)
        return F.when(s.contains("E"), F.concat(sign, form)).otherwise(s)

    # Some JVMs write digits too many; of texts that read back as the number the shorter one stands.
    def trimmed(text):
        mantissa = F.regexp_replace(F.regexp_replace(F.substring_index(text, "e", 1), "0+$", ""), r"\.$", ".0")
        return F.concat(mantissa, F.lit("E"), F.substring_index(text, "e", -1).cast("int").cast("string"))

    long = F.length(F.regexp_replace(F.regexp_replace(shown, "E.*$", ""), r"^-?0?\.?0*|\.|-", "")) >= 17
    full = F.format_string("%.16e", wide)
    cut = F.regexp_replace(full, r"^(-?[0-9][.][0-9]{15})[0-9]", "$1")
    for text in (full, cut, F.format_string("%.15e", wide)):
        shown = F.when(long & (text.try_cast("double") == wide), trimmed(text)).otherwise(shown)

    finite = ~F.isnan(wide) & (F.abs(wide) < float("inf"))
    return F.when(finite, let(shown, written)).when(wide.isNotNull(), F.raise_error(F.lit("JSON has no NaN and no infinities")).cast("string"))


def _joined(parts: Column, left: str, right: str) -> Column:
    return F.concat(F.lit(left), F.array_join(parts, ","), F.lit(right))


def canonical_json(value: Column, kind: P.DataType, sets: Collection[str] = (), path: str = "") -> Column:
    """Canonical JSON of a value of the given type; sets: dotted paths of arrays
    whose order doesn't count (elements add no step to a path)."""
    if isinstance(kind, P.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        at = lambda name: f"{path}.{name}" if path else name
        parts = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical_json(value[f.name], f.dataType, sets, at(f.name))) for f in fields]
        out = _joined(F.array(*parts), "{", "}") if parts else F.lit("{}")
    elif isinstance(kind, P.MapType):
        if not isinstance(kind.keyType, (P.StringType, P.IntegerType, P.LongType)):
            raise TypeError(f"keys of a JSON object are text: {kind.simpleString()}")
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value"))), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        out = _joined(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType, sets, path))), "{", "}")
    elif isinstance(kind, P.ArrayType):
        items = F.transform(value, lambda x: canonical_json(x, kind.elementType, sets, path))
        out = _joined(F.array_sort(items) if path in sets else items, "[", "]")
    elif isinstance(kind, P.StringType):
        out = quoted(value)
    elif isinstance(kind, P.BooleanType):
        out = F.when(value, "true").otherwise("false")
    elif isinstance(kind, (P.ByteType, P.ShortType, P.IntegerType, P.LongType, P.DecimalType)):
        out = value.cast("string")
    elif isinstance(kind, (P.FloatType, P.DoubleType)):
        out = number_text(value)
    elif isinstance(kind, P.DateType):
        out = F.concat(F.lit('"'), F.date_format(value, "yyyy-MM-dd"), F.lit('"'))
    elif isinstance(kind, (P.TimestampType, P.TimestampNTZType)):
        clock = F.to_utc_timestamp(value, F.current_timezone()) if isinstance(kind, P.TimestampType) else value
        part = F.when(F.date_format(clock, "SSSSSS") == "000000", "").otherwise(F.concat(F.lit("."), F.date_format(clock, "SSSSSS")))
        end = "Z" if isinstance(kind, P.TimestampType) else ""
        out = F.concat(F.lit('"'), F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit(f'{end}"'))
    elif isinstance(kind, P.NullType):
        out = F.lit("null")
    else:
        raise TypeError(f"no canonical JSON for {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(out)


def record_digest(df: DataFrame, columns: Collection[str], without: Collection[str] = (), sets: Collection[str] = ()) -> Column:
    """SHA-256 of the canonical JSON of the named columns of df but those in without (such as the digest itself)."""
    kept = [c for c in columns if c not in without]
    kind = P.StructType([df.schema[c] for c in kept])
    return F.sha2(canonical_json(F.struct(*kept), kind, sets), 256)


def sealed(df: DataFrame, digest: str = "record_sha256", sets: Collection[str] = ()) -> DataFrame:
    """df with a digest of each record's other columns."""
    return df.withColumn(digest, record_digest(df, df.columns, [digest], sets))


def seal_holds(df: DataFrame, digest: str = "record_sha256", sets: Collection[str] = ()) -> Column:
    """Whether a record's digest is that of its other columns."""
    return F.coalesce(F.col(digest) == record_digest(df, df.columns, [digest], sets), F.lit(False))
