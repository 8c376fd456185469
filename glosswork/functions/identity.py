"""Normal forms of personal identifiers; null where a value doesn't fit its rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\f\v"


def trimmed(value: Column) -> Column:
    """Without white space at the ends; null if nothing is left."""
    return F.nullif(F.btrim(value, F.lit(WHITE)), F.lit(""))


def document_number(kind: Column, value: Column) -> Column:
    """Digits alone for a DNI; letters and digits, in capitals, for LC, LE, CI and PASSPORT."""
    plain = trimmed(value)
    other = kind.isin("LC", "LE", "CI", "PASSPORT") & plain.rlike("^[A-Za-z0-9]+$")
    return F.when((kind == "DNI") & plain.rlike("^[0-9]+$"), plain).when(other, F.upper(plain))


def tax_number(value: Column) -> Column:
    """Eleven digits, written with or without hyphens and blanks."""
    plain = F.translate(F.btrim(value, F.lit(WHITE)), "- ", "")
    return F.when(plain.rlike("^[0-9]{11}$"), plain)


def email(value: Column) -> Column:
    return F.lower(F.btrim(value, F.lit(WHITE)))


def phone(value: Column) -> Column:
    return F.replace(F.btrim(value, F.lit(WHITE)), F.lit(" "), F.lit(""))
