"""Text normalisers and extractors as columns.

Patterns and word lists under "fixed values" must equal those of the formats
they describe. Unicode forms have no Spark expression, so NFC, NFKC, NFKD and
case folding run as Arrow functions; everything else is a JVM expression.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# --- fixed values -----------------------------------------------------------

MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
NUMBER_WORDS = {"ciento ochenta": "180", "noventa": "90", "sesenta": "60", "treinta": "30", "quince": "15", "diez": "10"}
SECTION_PATTERNS = [
    ("ARTICLE", r"(?iu)^\s*(?:ART[ÍI]CULO|ART\.?)[\s.:-]*(?:[0-9]+|[ÚU]NICO)"),
    ("VISTO", r"(?iu)^\s*VISTO\b"),
    ("CONSIDERANDO", r"(?iu)^\s*CONSIDERANDO\b"),
    ("DISPOSITIVE_INTRO", r"(?iu)^\s*(?:DECRETA|RESUELVE|DISPONE)\s*:?\s*$"),
    ("CLOSING", r"(?iu)^\s*(?:COMUNÍQUESE|COMUNIQUESE|REGÍSTRESE|REGISTRESE|PUBLÍQUESE|PUBLIQUESE|ARCHÍVESE|ARCHIVESE)\b"),
    ("AUTHORITY", r"(?iu)^\s*(?:PRESIDENTE|MINISTRO|MINISTRA|SECRETARIO|SECRETARIA|DIRECTOR|DIRECTORA)\b"),
    ("SIGNATURE", r"(?iu)^\s*(?:FIRMA|FIRMADO|FDO\.?|SIGNED|SIGNATURE)\b"),
]
ARTICLE_NUMBER = r"(?iu)^\s*(?:ART[ÍI]CULO|ART\.?)[\s.:-]*([0-9]+|[ÚU]NICO)"
WEB_LINE = r"(?i)^(?:skip\s+to\s+(?:main\s+)?content|menu|navigation|home|share|print|cookie\s+(?:policy|settings)|subscribe|search)$"
NEGATION = r"(?iu)\b(?:no|nunca|jam[aá]s|sin|prohibid[oa]s?|impide|impedir)\b"
#: An edge between words of ASCII letters, digits and underscores alone, as RE2 cuts them: other letters part words.
ASCII_EDGE = r"(?-iu:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
ASCII_NEGATION = NEGATION.replace(r"\b", ASCII_EDGE)
VERB = (
    r"(?iu)\b(es|son|ser[aá]|debe|deber[aá]|podr[aá]|puede|corresponde|rige|aplica|establece|vence|dura|tiene|incluye|proh[ií]be|autoriza|"
    r"ordena|obliga|cumple|incumple|solicita|requiere|presenta|emite|notifica|se[nñ]ala|indica|fija|otorga|designa|nombra|recae|consiste|deber[aá]n|podr[aá]n)\b"
)
CLAUSE = r"(?iu)\s+(?:y|e|pero|aunque|sin\s+embargo)\s+(?=(?:el|la|los|las|un|una|se|no|debe|deberá|debera|podrá|podra|puede|queda|resulta|es|son)\b)"
SENTENCE = r"(?<=[.!?])\s+|[;\n]+"
TYPED_CLAIMS = {
    "norma": r"(?i)\b(decreto|ley|resolucion|disposicion|decision\s+administrativa)\s*(?:n(?:ro\.?|[°ºo])?\s*)?(\d{1,6})\s*(?:/|de\s*)\s*(\d{2,4})\b",
    "fecha": r"(?i)\b(\d{1,2})\s+de\s+(" + "|".join(MONTHS) + r")\s+de\s+(\d{4})\b",
    "fecha_num": r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b",
    "plazo": r"(?i)\b(\d{1,5}|ciento\s+ochenta|noventa|sesenta|treinta|quince|diez)(?:\s*\(\s*(\d{1,5})\s*\))?\s+(dias?|mes(?:es)?|anos?)(?:\s+habiles?)?\b",
    "articulo": r"(?i)\b(?:articulo|art\.?)\s*(\d{1,4})",
    "jurisdiccion": r"(?i)\bjurisdiccion\s+(\d{1,3})\b",
    "expediente": r"(?i)\b(?:expediente|expte\.?)\s+(?:n(?:ro\.?|[°ºo])?\s*)?([A-Z0-9:/._-]{4,})",
    "monto": r"(?i)(?:\b(?:monto|importe|suma)\s*(?:de\s*)?|\$\s*)(\d[\d.,]*)\b",
    "dni": r"(?i)\b(?:dni|d\.n\.i\.?|documento(?:\s+nacional\s+de\s+identidad)?)\s*(?:nro?\.?\s*)?(\d{6,9})\b",
}
ENTITIES = [
    ("LEGAL_INSTRUMENT", r"(?iu)\b(?:Ley|Decreto|Resoluci[oó]n|Disposici[oó]n|Ordenanza|Sentencia|Acordada|Decisi[oó]n\s+Administrativa)\b(?:\s+(?:N(?:ro?\.?|[°ºo])?\s*)?)?[A-Z0-9][A-Z0-9./:-]*(?:\s*/\s*\d{2,4})?", 0),
    ("CASE", r"(?iu)\b(?:Expediente|Expte\.?|Causa|Autos)\s+(?:N(?:ro?\.?|[°ºo])?\s*)?[A-Z0-9][A-Z0-9:/._-]{2,}", 0),
    ("COURT", r"(?iu)\b(?:Corte|Tribunal|Juzgado|C[aá]mara|Fiscal[ií]a|Defensor[ií]a)\b[^,.;\n]*", 0),
    ("ORGANIZATION", r"(?U)\b(?:Ministerio|Secretar[ií]a|Direcci[oó]n|Administraci[oó]n|Instituto|Municipalidad|Provincia|Universidad|Banco|Estado|Agencia|Comisi[oó]n|Defensor[ií]a|Fiscal[ií]a)\b(?:\s+(?:de|del|la|las|los|y|[A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑ'-]*)){0,9}", 0),
    ("PERSON", r"(?U)\b(?:Sr\.?|Sra\.?|Dr\.?|Dra\.?|Lic\.?|Abg\.?)\s+([A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑ'-]+(?:\s+[A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑ'-]+){1,3})", 1),
    ("ORGANIZATION", r"(?U)\b[A-ZÁÉÍÓÚÑ]{3,}(?:\s+[A-ZÁÉÍÓÚÑ]{2,})?\b", 0),
]
NOISE_ACRONYMS = ["TP", "FP", "FN", "PDF", "JSON", "HTTP", "UTC"]

#: Stop words of faithfulness tokens.
FAITHFULNESS_STOPWORDS = [
    "a", "al", "ante", "con", "contra", "de", "del", "desde", "durante", "e", "el", "ella", "ellas", "ellos", "en", "entre", "es", "esta", "este", "estos",
    "la", "las", "lo", "los", "of", "on", "or", "para", "por", "que", "se", "segun", "sin", "su", "sus", "the", "to", "un", "una", "y", "and",
]

# --- end of fixed values ----------------------------------------------------


def _bases(form: str, codes) -> tuple[str, str]:
    """Characters of codes whose normal form without marks is one other character, and those characters."""
    pairs = []
    for c in map(chr, codes):
        plain = "".join(x for x in unicodedata.normalize(form, c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            pairs.append((c, plain))
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


def _class(chars: str) -> str:
    """A class of characters as ranges beyond Latin-1's first half: a pattern tries the
    members of a class one after another, for each character of a text."""
    codes, spans = sorted(map(ord, chars)), []
    for c in codes:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    ranges = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)
    return f"[[\\x{{{codes[0]:x}}}-\\x{{{codes[-1]:x}}}]&&[{ranges}]]"


#: Marked letters and their bases: Latin-1, and all of the basic plane without Hangul and Han.
MARKED, BARE = _bases("NFD", range(0x80, 0x100))
WIDE_MARKED, WIDE_BARE = _bases("NFD", [*range(0x80, 0x3000)])
#: Besides marks, forms for compatibility of letters and digits (raised, circled, full-width).
ALIKE, ALIKE_BARE = (
    "".join(x)
    for x in zip(*((c, p) for c, p in zip(*_bases("NFKD", [*range(0x80, 0x3300), *range(0xFF01, 0xFF5F)]), strict=True) if re.match("[A-Za-z0-9]", p)), strict=True)
)
#: Ligatures, digraphs and fractions: one character that stands for several.
JOINED = {c: unicodedata.normalize("NFKD", c) for c in map(chr, [0xBC, 0xBD, 0xBE, 0x132, 0x133, 0x13F, 0x140, 0x149, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0x2150, 0x215F), *range(0xFB00, 0xFB07)])}
COMBINING = _class("".join(c for c in map(chr, [*range(0x300, 0x3100), *range(0xFE20, 0xFE30)]) if all(map(unicodedata.combining, unicodedata.normalize("NFKD", c)))))


def let(value: Column, body) -> Column:
    """body(value) with value computed once; a name used inside a lambda is computed for every element otherwise."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def first_by_key(items: Column) -> Column:
    """The first of the items (structs) with equal key."""
    return let(items, lambda xs: let(F.transform(xs, lambda x: x["key"]), lambda ks: F.filter(xs, lambda x, i: F.array_position(ks, x["key"]) == i + 1)))


# --- Unicode forms ----------------------------------------------------------


def unicode_form(form: str, fold: bool = False, strip_marks: bool = False):
    """A function of text: a normal form, case folding, combining marks dropped."""

    @pandas_udf("string")
    def convert(texts):
        import unicodedata

        def one(t):
            if t is None:
                return None
            t = unicodedata.normalize(form, t)
            if strip_marks:
                t = "".join(c for c in t if not unicodedata.combining(c))
            return t.casefold() if fold else t

        return texts.map(one)

    return convert


def strip_accents(text: Column) -> Column:
    """Marked letters to their bases, written as one character or as two, without leaving the JVM."""
    wide = F.translate(F.regexp_replace(text, COMBINING, ""), WIDE_MARKED, WIDE_BARE)
    return F.when(text.rlike(r"[^\x00-\xFF]"), wide).otherwise(F.translate(text, MARKED, BARE))


def comparison_form(text: Column, exact: bool = False) -> Column:
    """Lower-case letters and digits of the text, words parted by one space.

    exact: by NFKD in an Arrow function; otherwise by tables that hold the same
    for all letters and digits but a few (mathematical alphabets, units of
    measure written as one character).
    """
    if exact:
        plain = unicode_form("NFKD", strip_marks=True)(text)
    else:
        apart = text
        for c, parts in JOINED.items():
            apart = F.replace(apart, F.lit(c), F.lit(parts))
        apart = F.when(text.rlike(_class("".join(JOINED))), apart).otherwise(text)
        alike = F.translate(F.regexp_replace(apart, COMBINING, ""), ALIKE, ALIKE_BARE)
        plain = F.when(text.rlike(r"[^\x00-\xBB\xBF-\xFF]|[\xAA\xB2\xB3\xB9\xBA]"), alike).otherwise(F.translate(text, MARKED, BARE))
    return F.trim(F.regexp_replace(F.lower(plain), r"[^a-z0-9]+", " "))


def semantic_form(text: Column) -> Column:
    """NFKC, case-folded, white space squashed; marks and punctuation stay."""
    return F.trim(F.regexp_replace(unicode_form("NFKC", fold=True)(text), r"(?U)\s+", " "))


def faithfulness_tokens(text: Column, stopwords: list[str] = FAITHFULNESS_STOPWORDS) -> Column:
    plain = F.lower(unicode_form("NFKD", strip_marks=True)(F.replace(text, F.lit("\0"), F.lit(" "))))
    words = F.regexp_extract_all(plain, F.lit(r"(?U)\w+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stopwords)) if stopwords else words


def canonical_code(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(strip_accents(text)), r"[^a-z0-9]+", "_"), F.lit("_"))


def canonical_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def clean_extracted(text: Column) -> Column:
    """Without links and page marks, squashed, trimmed of punctuation."""
    plain = F.regexp_replace(text, r"https?://\S+", " ")
    plain = F.regexp_replace(plain, r"(?iu)P[áa]gina\s+\d+", " ")
    return F.btrim(F.regexp_replace(plain, r"\s+", " "), F.lit(" .,;:-"))


def normalize_corpus(text: Column, headers: list[str] | None = None, nfc: bool = True) -> Column:
    """struct<content, bom_removed, controls_removed, lines_removed, endings_changed>; content null when empty."""
    base = unicode_form("NFC")(text) if nfc else text
    bom = base.startswith("﻿")
    plain = F.regexp_replace(F.ltrim(base, F.lit("﻿")), r"\r\n|\r", "\n")
    control = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x80-\x9F]"
    lines = F.transform(F.split(F.regexp_replace(plain, control, ""), "\n"), lambda s: F.btrim(F.regexp_replace(F.replace(s, F.lit("\t"), F.lit(" ")), " {2,}", " ")))
    known = [h.strip().lower() for h in headers or []]
    goes = lambda s: s.rlike(WEB_LINE) | (canonical_line(s).isin(*known) if known else F.lit(False))
    kept = F.filter(lines, lambda s: ~goes(s))
    joined = F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"(?iu)\bARTICULO\b", "ARTÍCULO"), r"\n{3,}", "\n\n")
    content = F.btrim(joined, F.lit(" \n"))
    return F.struct(
        F.when(content != "", content).alias("content"),
        bom.alias("bom_removed"),
        F.regexp_count(plain, F.lit(control)).alias("controls_removed"),
        (F.size(lines) - F.size(kept)).alias("lines_removed"),
        base.contains("\r").alias("endings_changed"),
    )


# --- sections, tokens, claims -----------------------------------------------


def section_of(line: Column) -> Column:
    """The section that a line opens, null for none; the first pattern wins."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SECTION_PATTERNS):
        out = F.when(line.rlike(pattern), name).otherwise(out)
    return out


def article_number(line: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(line, ARTICLE_NUMBER, 1)), F.lit(""))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def visible_text(html: Column) -> Column:
    """Text of well-formed HTML: ignored elements dropped, block tags end lines."""
    plain = F.regexp_replace(html, r"(?is)<(script|style|noscript|template|nav|footer|head)\b[^>]*>.*?</\1\s*>", "")
    plain = F.regexp_replace(plain, r"(?is)<!--.*?-->", "")
    plain = F.regexp_replace(plain, r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|section|article|h[1-6]|title|header|main)\b[^>]*>", "\n")
    plain = F.regexp_replace(plain, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    plain = F.regexp_replace(plain, r"[ \t]+", " ")
    return F.btrim(F.regexp_replace(plain, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def typed_claims(text: Column, two_word_norms: bool = False) -> Column:
    """Sorted distinct kind:value codes of protected values in the text."""
    plain = strip_accents(text)

    def each(kind, build):
        pattern = TYPED_CLAIMS[kind]
        found = F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))
        group = lambda m, i: F.regexp_extract(m, pattern, i)
        return F.transform(found, lambda m: build(lambda i: group(m, i)))

    number = lambda c: F.coalesce(F.ltrim(c, F.lit("0")), F.lit(""))
    as_int = lambda c: F.when(number(c) == "", "0").otherwise(number(c))
    squash = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    words = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))

    def term(g):
        unit = squash(g(3))
        amount = F.when(g(2) != "", g(2)).otherwise(F.coalesce(F.try_element_at(words, squash(g(1))), squash(g(1))))
        return F.concat(F.lit("plazo:"), amount, F.lit(":"), F.when(unit.startswith("dia"), "dias").otherwise(unit))

    parts = [
        each("norma", lambda g: F.concat(F.lit("norma:"), squash(g(1)), F.lit(":"), as_int(g(2)), F.lit("/"), g(3))),
        each("fecha", lambda g: F.concat(F.lit("fecha:"), as_int(g(1)), F.lit(":"), squash(g(2)), F.lit(":"), g(3))),
        each("fecha_num", lambda g: F.concat(F.lit("fecha:"), as_int(g(1)), F.lit(":"), as_int(g(2)), F.lit(":"), g(3))),
        each("plazo", term),
        each("articulo", lambda g: F.concat(F.lit("articulo:"), as_int(g(1)))),
        each("jurisdiccion", lambda g: F.concat(F.lit("jurisdiccion:"), as_int(g(1)))),
        each("expediente", lambda g: F.concat(F.lit("expediente:"), F.replace(squash(g(1)), F.lit(" "), F.lit("")))),
        each("monto", lambda g: F.concat(F.lit("monto:"), F.regexp_replace(g(1), "[^0-9]", ""))),
        each("dni", lambda g: F.concat(F.lit("dni:"), g(1))),
    ]
    if two_word_norms:
        pattern = r"\b(\d{1,6})\s+(\d{2,4})\b"
        pairs = F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))
        parts.append(F.transform(pairs, lambda m: F.concat(F.lit("norma:decreto:"), as_int(F.regexp_extract(m, pattern, 1)), F.lit("/"), F.regexp_extract(m, pattern, 2))))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def clean_claim(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" \t\r\n.;,:"))


def polarity(text: Column, negation: str = NEGATION) -> Column:
    return F.when(text.rlike(negation), "NEGATED").otherwise("AFFIRMED")


def atomic_claims(text: Column) -> Column:
    """array<struct<text, subject, predicate, object, polarity, key>>: sentences, then clauses; the first of equal keys stays."""
    clauses = F.flatten(F.transform(F.split(text, SENTENCE), lambda s: F.split(s, CLAUSE)))
    cleaned = F.filter(F.transform(clauses, clean_claim), lambda c: c != "")

    def one(c):
        verb = F.regexp_extract(c, VERB, 1)
        at = F.instr(F.regexp_replace(c, VERB, "\0$1\0"), "\0")
        has = at > 0
        subject = F.when(has, comparison_form(F.regexp_replace(F.substr(c, F.lit(1), at - 1), NEGATION, " "))).otherwise("")
        obj = F.when(has, comparison_form(F.substr(c, at + F.length(verb)))).otherwise(comparison_form(c))
        pol = polarity(c)
        predicate = F.when(has, comparison_form(verb)).otherwise("")
        key = F.when(has, F.concat_ws("|", subject, predicate, obj, pol)).otherwise(F.concat_ws("|", F.lit("text"), obj, pol))
        return F.struct(c.alias("text"), subject.alias("subject"), predicate.alias("predicate"), obj.alias("object"), pol.alias("polarity"), key.alias("key"))

    return first_by_key(F.transform(cleaned, one))


def entities(text: Column) -> Column:
    """array<struct<kind, text, key>> in order of the kinds; the first of equal keys stays."""
    parts = []
    for kind, pattern, group in ENTITIES:
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), clean_claim)
        if kind == "ORGANIZATION" and pattern.startswith(r"(?U)\b[A-Z"):
            found = F.filter(found, lambda m: ~m.isin(*NOISE_ACRONYMS))
        parts.append(_entity(found, kind))
    return first_by_key(F.concat(*parts))


def _entity(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("text"), F.concat_ws("|", F.lit(kind), comparison_form(m)).alias("key")))


def identifier(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(key, 256), 1, 12))


def parse_date(text: Column) -> Column:
    """ISO, then d/m/y (two digits: 20yy), then D de MES de YYYY; null if none."""
    number = r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{2}|\d{4})\s*$"
    year = F.regexp_extract(text, number, 3)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    dmy = F.concat_ws("-", full, F.lpad(F.regexp_extract(text, number, 2), 2, "0"), F.lpad(F.regexp_extract(text, number, 1), 2, "0"))
    worded = r"(?iu)^\s*(\d{1,2})\s+de\s+([a-z]+)\s+de\s+(\d{4})\s*$"
    months = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}")))
    month = F.try_element_at(months, F.lower(F.regexp_extract(text, worded, 2)))
    long = F.concat_ws("-", F.regexp_extract(text, worded, 3), F.coalesce(month, F.lit("00")), F.lpad(F.regexp_extract(text, worded, 1), 2, "0"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    return F.coalesce(F.try_to_date(iso), F.try_to_date(F.when(text.rlike(number), dmy)), F.try_to_date(F.when(text.rlike(worded), long)))


# --- similarity -------------------------------------------------------------


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(comparison_form(text), " "), lambda w: w != ""))


def token_recall(expected: Column, candidate: Column, empty: float = 1.0) -> Column:
    want = token_set(expected)
    return F.when(F.size(want) == 0, empty).otherwise(F.size(F.array_intersect(want, token_set(candidate))) / F.size(want))


def rouge_l():
    """A function of candidate and reference: F1 of the longest common subsequence of words."""

    @pandas_udf("double")
    def score(candidates, references):
        import pandas as pd

        def lcs(a, b):
            # One bit per word of a; Hyyro's row update keeps the count of matches.
            where: dict[str, int] = {}
            for i, w in enumerate(a):
                where[w] = where.get(w, 0) | 1 << i
            full = (1 << len(a)) - 1
            row = full
            for w in b:
                hit = row & where.get(w, 0)
                row = ((row + hit) | (row - hit)) & full
            return len(a) - row.bit_count()

        out = []
        for c, r in zip(candidates, references, strict=True):
            if c is None or r is None:
                out.append(None)
                continue
            a, b = c.split(), r.split()
            n = lcs(a, b) if a and b else 0
            out.append(2 * n / (len(a) + len(b)) if n else 0.0)
        return pd.Series(out, dtype="float64")

    return score


def chrf(order: int = 6, beta: float = 2.0):
    """A function of candidate and reference: F-beta of character n-gram precision and recall, averaged over the orders both have.

    N-grams of a batch are numbered by pairing the number of the shorter one with
    the next character, and common ones are counted by one sort for each order.
    """

    @pandas_udf("double")
    def score(candidates, references):
        import numpy as np
        import pandas as pd

        missing = (candidates.isna() | references.isna()).to_numpy()
        sides = [["" if x is None else "".join(x.split()) for x in side] for side in (candidates, references)]
        n = len(candidates)
        texts = sides[0] + sides[1]
        sizes = np.array([len(x) for x in texts], np.int64)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        row = np.repeat(np.arange(2 * n), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))  # characters from each place to its text's end
        lengths = sizes.reshape(2, n)
        top = np.minimum(order, lengths.min(axis=0))
        p, q = np.zeros(n), np.zeros(n)
        gram = np.zeros(len(chars), np.int64)
        for k in range(1, order + 1):
            whole = left >= k
            at = np.flatnonzero(whole)
            pair = np.full(len(chars), -1, np.int64)
            pair[at] = gram[at] * (1 << 21) + chars[at + k - 1]
            values, number = np.unique(pair[at], return_inverse=True)
            gram[at] = number
            # Counts of each n-gram in each text; a text's candidate and reference share a pair of keys.
            key, count = np.unique(row[at] * max(1, len(values)) + number, return_counts=True)
            text, own = key // max(1, len(values)), key % max(1, len(values))
            case = text % n if n else text
            by = np.lexsort((text, own, case))
            same = (case[by][1:] == case[by][:-1]) & (own[by][1:] == own[by][:-1])
            hit = np.bincount(case[by][1:][same], np.minimum(count[by][1:], count[by][:-1])[same], n)
            part = k <= top
            with np.errstate(divide="ignore", invalid="ignore"):
                p += np.where(part, hit / (lengths[0] - k + 1) / top, 0.0)
                q += np.where(part, hit / (lengths[1] - k + 1) / top, 0.0)
        square = beta * beta
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(p + q > 0, (1 + square) * p * q / (square * p + q), 0.0)
        equal = np.array([a == b for a, b in zip(*sides, strict=True)], bool)
        out = np.where(top == 0, equal.astype(float), out)
        return pd.Series(np.where(missing, np.nan, out)).astype("float64").where(~missing, None)

    return score


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    k = beta * beta
    return F.coalesce(F.try_divide((1 + k) * precision * recall, k * precision + recall), F.lit(0.0))
