"""What decrees say, as columns: material claims, legal fields and their canonical
forms, reference facts of a published text, and the parts of a drafting prompt.

Texts are expected in NFC or NFKC. A null text gives null, a text without a match
an empty array, an absent key or the default stated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswork.functions.text import MONTHS, comparison_form, first_by_key, let

# --- fixed values -----------------------------------------------------------

MATERIAL = {
    "norma": r"(?iU)\b(Decreto|Ley|Resoluci[oó]n|Decisi[oó]n\s+Administrativa)\s*(?:N(?:ro\.?|[°ºo])?\s*)?(\d{1,6})(?:\s*/\s*(\d{2,4}))?",
    "fecha": r"(?iU)\b(\d{1,2})\s+de\s+(" + "|".join(MONTHS) + r")\s+de\s+(\d{4})\b",
    "fecha_num": r"(?U)\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b",
    "plazo": r"(?iU)(?<!\d)\(?(\d{1,5})\)?\s+(d[ií]as?|mes(?:es)?|a[nñ]os?)\b",
    "expediente": r"(?iU)\bExpediente\s+(?:N(?:ro\.?|[°ºo])?\s*)?([A-Z0-9:/.-]{4,})",
    "articulo": r"(?iU)\bart[ií]culo\s+(\d{1,4})(?:\s*[,;]?\s*inciso\s+(\d{1,3}))?",
}
FIELDS = {
    "norma": [r"(?iU)\b(decreto(?:-ley)?|ley|resoluci[oó]n|decisi[oó]n\s+administrativa|ordenanza)\s*(?:n(?:ro\.?|[°ºo])?\s*)?([0-9]{1,3}(?:\.[0-9]{3})*|[0-9]{1,7})(?:\s*/\s*([0-9]{2,4}))?"],
    "fecha": [
        r"(?U)\b([0-9]{4})-([0-9]{2})-([0-9]{2})\b",
        r"(?U)\b([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})\b",
        r"(?iU)\b([0-9]{1,2})\s+de\s+([a-záéíóú]+)\s+de\s+([0-9]{4})\b",
    ],
    "plazo": [r"(?iU)(?<!\w)(?:dentro\s+de\s+|en\s+un\s+plazo\s+de\s+|por\s+)?(\d{1,7}|[a-záéíóú]+)\s*(?:\((\d{1,7})\))?\s*(d[ií]as?|semanas?|mes(?:es)?|a[nñ]os?|days?|weeks?|months?|years?)\b"],
    "expediente": [r"(?iU)\bexpediente\s*(?:n(?:ro\.?|[°ºo])?\s*)?([a-z0-9][a-z0-9:/._-]{2,})"],
    "referencias": [r"(?iU)\b(?:art[ií]culo|art\.?)\s*([0-9]{1,5})(?:\s*[,;]?\s*(?:inciso|apartado)\s*([a-z0-9]{1,4}))?"],
}
UNITS = {
    "day": ("dia", "dias", "day", "days"),
    "week": ("semana", "semanas", "week", "weeks"),
    "month": ("mes", "meses", "month", "months"),
    "year": ("ano", "anos", "year", "years"),
}
NUMBERS = {
    "cero": 0, "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10,
    "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15, "dieciseis": 16, "diecisiete": 17, "dieciocho": 18, "diecinueve": 19,
    "veinte": 20, "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90, "cien": 100, "ciento": 100,
}
PLACE_LINE = r"(?iU)^(Bs\.?\s*As\.?|Buenos Aires)"
HEADINGS = ["VISTO:", "VISTOS:", "CONSIDERANDO:", "CONSIDERANDO"]
CITED = r"(?iU)(?-iU:(?=[DdLlRr]))\b(?:Decreto|Ley|Resoluci[oó]n|Decisi[oó]n Administrativa)\s*(?:N[°ºo]\s*)?([0-9]+(?:/[0-9]{2,4})?)"
#: An article's text ends before the next article, an annex or at the end; only an A may begin one of the first two.
REFERENCE_ARTICLE = r"(?isU)(?-iU:(?=[Aa]))\b(?:Art[íi]culo|Art\.)\s*(\d+)\s*[º°ª]?\s*[–—-]?\s*((?-iU:[^Aa]*+)(?:(?!\b(?:Art[íi]culo|Art\.)\s*\d+\b|\bANEXO\b)(?-iU:[Aa][^Aa]*+))*+)"
CRITICAL = [(r"pr[oó]rrog\w*", 140), (r"designaci[oó]n\w*", 140), (r"ces\w*", 140), (r"\d+\s+d[ií]as?", 100), (r"Expediente", 120)]
#: What a term may begin with; tested first, as the edge of a word is dear to test.
CRITICAL_HEADS = ("[Pp]", "[Dd]", "[Cc]", r"[^\x00-/:-\x7F]", "[Ee]")
CRITICAL_LEAD = 80
FOOTER = r"(?iU)https?://\S+|P[aá]gina\s+\d+|BOLET[IÍ]N\s+OFICIAL"
TARGET = r"(?iU)\bDecreto\s+(?:N[º°o.]\s*)?(\d{1,5}/\d{2,4})\b"
DATE_LINE = r"(?iU)\b(?:Bs\.\s*As\.|(?:Ciudad de\s+)?Buenos Aires),?\s+\d{1,2}/\d{1,2}/\d{2,4}\b"
SIGNED = r"(?iU)\b(?:Fdo\.?|Firmado|firma digital|certificado digital|refrendad[oa]|Ministro firmante)\b"
SECTION_END = r"(?iU)\n\s*(?:Por ello,|LA PRESIDENTA|EL PRESIDENTE)"
VISTO_END = r"(?iU)\n\s*(?:CONSIDERANDO\s*:|Por ello,|LA PRESIDENTA|EL PRESIDENTE)"
FACT_END = r"(?iU)\n\s*(?:LA PRESIDENTA|EL PRESIDENTE|Art[ií]culo\s+1|Fecha de publicaci[oó]n|e\.\s+\d)"
PROMPT_ARTICLE = r"(?isU)(?:Art[ií]culo|Art\.)\s*(\d+)[º°o.]?\s*(?:\.\s*)?[—-]\s*(.*?)(?=\n\s*(?:Art[ií]culo|Art\.)\s*\d+|\z)"
FORMAL = r"(?iU)comun[ií]quese|publ[ií]quese|dese a la"
DOCUMENT_CODE = r"(?iU)^[A-Z]+-\d{4}-\d+-APN-[A-Z0-9#_-]+\s*-\s*"
OBJECTIVES = {
    r"^Danse por prorrogadas?": "instrumentar la prórroga de",
    r"^Dase por prorrogada?": "instrumentar la prórroga de",
    r"^Desígnase": "instrumentar una designación en",
    r"^Designación": "instrumentar una designación",
    r"^Apruébase": "aprobar",
    r"^Créase": "crear",
    r"^Modifícase": "modificar",
    r"^Autorízase": "autorizar",
}
REQUIREMENTS = {
    r"^Danse por prorrogadas?": "Prorrogar",
    r"^Dase por prorrogada?": "Prorrogar",
    r"^Nómbrase,?\s*": "Disponer el nombramiento de ",
    r"^Desígnase,?\s*": "Disponer la designación de ",
    r"^Apruébase": "Aprobar",
    r"^Autorízase": "Autorizar",
    r"^Acéptase": "Aceptar",
    r"^Asígnase": "Asignar",
    r"^Incorpórase": "Incorporar",
    r"^Conviértese": "Convertir",
    r"^Derógase": "Derogar",
    r"^Facúltase": "Facultar",
    r"^Convócase": "Convocar",
    r"^Decláranse": "Declarar",
}
PRIORITY = ["objeto", "razones", "solicita", "necesidad", "cargo", "estructura", "presupuesto", "crédito", "jurídic", "atribuciones", "facultades", "vigencia", "plazo", "selección", "designación", "servicio"]
NO_TARGET = "no-detectado"
NO_ORGANISATION = "Organismo nacional competente"
NO_OBJECTIVE = "instrumentar una medida administrativa nacional debidamente fundada"
VISTO_FACT = "El expediente y los antecedentes normativos relevantes comprenden: "
OTHER_FACT = "La decisión debe considerar el siguiente fundamento y antecedente operativo: "
REDACTED = "la medida proyectada"

#: White space of any script, as (?U)\s has it; letters and marks of ASCII are told apart first.
BLANK = r"[[^!-\x7E]&&[\t-\r \x85\xA0  -     　]]"

# --- shared pieces ----------------------------------------------------------


def _matches(text: Column, pattern: str, build) -> Column:
    """build(group) of each match, group(i) being its i-th group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m: build(lambda i: F.regexp_extract(m, pattern, i)))


def _whole(digits: Column) -> Column:
    """Digits without leading zeros."""
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def _or_dash(value: Column) -> Column:
    return F.when(value == "", "-").otherwise(value)


def _code(*parts) -> Column:
    return F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _squash(text: Column) -> Column:
    """Runs of blanks as one space; single spaces are left as they are."""
    return F.btrim(F.regexp_replace(text, f" {BLANK}+|(?! ){BLANK}+", " "))


def _before(text: Column, pattern: str) -> Column:
    return F.get(F.split(text, pattern, 2), F.lit(0))


def _after(text: Column, pattern: str) -> Column:
    """What follows the first match; null without one."""
    return F.get(F.split(text, pattern, 2), F.lit(1))


def _none() -> Column:
    return F.array().cast("array<string>")


# --- claims and fields ------------------------------------------------------


def material_claims(text: Column) -> Column:
    """Sorted distinct kind:value codes; a norm's year and an article's paragraph are "-" where absent."""
    plain = lambda c: comparison_form(c)
    joined = lambda c, by: F.replace(plain(c), F.lit(" "), F.lit(by))
    parts = [
        _matches(text, MATERIAL["norma"], lambda g: _code("norma", joined(g(1), "_"), _whole(g(2)), _or_dash(g(3)))),
        _matches(text, MATERIAL["fecha"], lambda g: _code("fecha", _whole(g(1)), plain(g(2)), g(3))),
        _matches(text, MATERIAL["fecha_num"], lambda g: _code("fecha_num", _whole(g(1)), _whole(g(2)), g(3))),
        _matches(text, MATERIAL["plazo"], lambda g: _code("plazo", _whole(g(1)), plain(g(2)))),
        _matches(text, MATERIAL["expediente"], lambda g: _code("expediente", joined(g(1), ""))),
        _matches(text, MATERIAL["articulo"], lambda g: _code("articulo", _whole(g(1)), _or_dash(_whole(g(2))))),
    ]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def legal_fields(text: Column) -> Column:
    """map of field to its mentions, distinct and in order of the text; a field without a mention has no key."""
    pairs = []
    for name, patterns in FIELDS.items():
        found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns))
        pairs += [F.lit(name), F.array_distinct(found)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.size(v) > 0)


def canonical_norms(value: Column) -> Column:
    """kind:number:year of every norm named, sorted; the comparison form of a text without one."""
    pattern = FIELDS["norma"][0]
    found = _matches(value, pattern, lambda g: _code(F.replace(comparison_form(g(1)), F.lit(" "), F.lit("_")), _whole(F.replace(g(2), F.lit("."), F.lit(""))), _or_dash(g(3))))
    plain = comparison_form(value)
    return F.when(F.size(found) > 0, F.array_sort(found)).when(plain != "", F.array(plain)).otherwise(_none())


def canonical_term(value: Column) -> Column:
    """amount:unit of the first term; the number in brackets wins, words count; null if either is unknown."""
    pattern = FIELDS["plazo"][0]
    numbers = F.create_map(*(F.lit(x) for word, n in NUMBERS.items() for x in (word, str(n))))
    units = F.create_map(*(F.lit(x) for unit, words in UNITS.items() for word in words for x in (word, unit)))
    shown, bracket = F.regexp_extract(value, pattern, 1), F.regexp_extract(value, pattern, 2)
    said = F.when(bracket != "", bracket).otherwise(shown)
    amount = F.coalesce(F.try_element_at(numbers, comparison_form(said)), F.when(said.rlike(r"^\d+$"), _whole(said)))
    return F.concat(amount, F.lit(":"), F.try_element_at(units, comparison_form(F.regexp_extract(value, pattern, 3))))


def canonical_file(value: Column) -> Column:
    """A file's number in capital letters and digits; null under three."""
    named = F.regexp_extract(value, FIELDS["expediente"][0], 1)
    code = F.upper(F.regexp_replace(F.when(named != "", named).otherwise(value), "[^A-Za-z0-9]", ""))
    return F.when(F.length(code) >= 3, code)


def canonical_reference(value: Column) -> Column:
    """article:number:paragraph of every article named, joined by |; else the comparison form; null if that is empty."""
    found = _matches(value, FIELDS["referencias"][0], lambda g: _code("article", _whole(g(1)), _or_dash(comparison_form(g(2)))))
    return F.when(F.size(found) > 0, F.array_join(found, "|")).otherwise(F.nullif(comparison_form(value), F.lit("")))


def canonical_fields(fields: Column) -> Column:
    """The map of legal_fields() with canonical values; dates stay as written."""
    one = {"plazo": canonical_term, "expediente": canonical_file, "referencias": canonical_reference}

    def values(name, items):
        out = items
        for field, rule in one.items():
            out = F.when(name == field, F.array_compact(F.transform(items, rule))).otherwise(out)
        return F.when(name == "norma", F.flatten(F.transform(items, canonical_norms))).otherwise(out)

    return F.transform_values(fields, values)


# --- facts of a published decree --------------------------------------------


def _shouted(line: Column, letters: int, counted: str) -> Column:
    """Whether a line has enough letters and all of them are capitals."""
    return ~line.rlike("[a-záéíóúüñ]") & line.rlike(f"^(?:[^{counted}]*+[{counted}]){{{letters}}}")


def _numbered(values: Column, field: str, prefix: str) -> Column:
    return F.transform(values, lambda v, i: F.struct(F.concat(F.lit(prefix + "-"), i.cast("string")).alias("fact_id"), F.lit(field).alias("field"), v.alias("text")))


def reference_facts(text: Column, title_chars: int = 700, organisations: int = 12, snippets: int = 20, critical: bool = True) -> Column:
    """array<struct<fact_id, field, text>> of a published decree, as its lines give them.

    Authority: the last line in capitals before the first that names a decree.
    Object: the lines from there to the place and date, no further once over
    title_chars. Dependencies: the first lines in capitals. Norms: sorted. Articles:
    from DECRETA on, the last of equal numbers. Critical: snippets around terms.
    The three bounds belong to the format. Without critical these facts alone are left out.
    """
    kept = F.filter(F.transform(F.split(text, r"\R"), _squash), lambda x: x != "")
    return let(kept, lambda lines: F.concat(_heading_facts(lines, title_chars), _body_facts(lines, organisations, snippets, critical)))


def _fact(key, field: str, value: Column) -> Column:
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("fact_id"), F.lit(field).alias("field"), value.alias("text"))


def _place(lines: Column, pattern: str) -> Column:
    """1-based place of the first line with the pattern, 0 without one."""
    return F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True).cast("int")


def _heading_facts(lines: Column, title_chars: int) -> Column:
    def authority(first):
        above = F.filter(F.slice(lines, 1, first - 1), lambda x: _shouted(x, 8, "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"))
        return F.try_element_at(above, F.lit(-1))

    def title(tail):
        def joined(end):
            own = F.filter(F.when(end > 0, F.slice(tail, 1, F.greatest(end - 1, F.lit(0)))).otherwise(tail), lambda x: ~F.upper(x).isin(*HEADINGS))
            return F.aggregate(own, F.lit(""), lambda t, x: F.when(F.length(t) > title_chars, t).when(t == "", x).otherwise(F.concat_ws(" ", t, x)))

        return let(_place(tail, PLACE_LINE), joined)

    def found(first):
        below = F.slice(lines, first + 1, F.greatest(F.size(lines), F.lit(1)))
        return F.array(_fact("organismo", "organismo", authority(first)), _fact("objeto", "objeto", let(below, title)), _fact("fecha", "fecha_plazo_vigencia", date))

    date = F.get(F.filter(lines, lambda x: x.rlike(PLACE_LINE)), F.lit(0))
    first = F.greatest(_place(lines, r"(?iU)(?-iU:(?=[Dd]))\bDecreto\b"), F.lit(1))
    return F.filter(let(first, found), lambda x: F.coalesce(x["text"], F.lit("")) != "")


def _snippets(parts: Column, term: str, rest: int, head: str) -> Column:
    """Each mention of a term with up to CRITICAL_LEAD characters before and rest after; parts hold no full stop, so none is crossed."""
    core = f"(?-iU:(?={head}))" + r"\b" + term + r"\b"
    around = f"(?iU)[^.]{{0,{CRITICAL_LEAD}}}{core}[^.]{{0,{rest}}}"
    return F.flatten(F.transform(F.filter(parts, lambda x: x.rlike("(?iU)" + core)), lambda x: F.regexp_extract_all(x, F.lit(around), F.lit(0))))


def _body_facts(lines: Column, organisations: int, snippets: int, with_critical: bool) -> Column:
    def articles(body):
        part = lambda i: F.regexp_extract_all(body, F.lit(REFERENCE_ARTICLE), F.lit(i))
        pairs = F.transform(F.arrays_zip(part(1).alias("n"), part(2).alias("t")), lambda x: F.struct(x["n"].cast("int").alias("key"), _squash(x["t"]).alias("t")))
        last = first_by_key(F.reverse(F.filter(pairs, lambda x: x["t"] != "")))
        return F.transform(F.array_sort(last), lambda x: _fact(F.concat(F.lit("articulo-"), x["key"].cast("string")), "articulos_resolutivos", x["t"]))

    def of_text(joined):
        start = F.instr(F.upper(joined), "DECRETA")
        norms = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(joined, F.lit(CITED), F.lit(1)), lambda x: comparison_form(x))))
        around = let(F.split(joined, r"\."), lambda parts: F.concat(*(_snippets(parts, *term, head) for term, head in zip(CRITICAL, CRITICAL_HEADS, strict=True))))
        critical = F.array_distinct(F.transform(around, _squash))
        return F.concat(
            _numbered(norms, "normas_citadas", "norma"),
            let(F.when(start > 0, F.substr(joined, start)).otherwise(joined), articles),
            *([_numbered(F.slice(critical, 1, snippets), "datos_criticos", "critico")] if with_critical else []),
        )

    dependencies = F.slice(F.filter(lines, lambda x: _shouted(x, 10, "A-Za-z")), 1, organisations)
    return F.concat(_numbered(dependencies, "dependencia", "dependencia"), let(F.array_join(lines, "\n"), of_text))


# --- parts of a drafting prompt ---------------------------------------------


def _plain(text: Column) -> Column:
    return F.btrim(_squash(F.regexp_replace(text, FOOTER, " ")), F.lit(" -—"))


def sentence(text: Column, most: int = 620) -> Column:
    """A clean sentence: no footer, no leading "Que", signatures masked, at most so many characters, at a full stop if one stands late enough."""
    clean = F.regexp_replace(F.regexp_replace(_plain(text), r"(?iU)^Que\s+", ""), SIGNED, "[DATO EXCLUIDO]")

    def cut(v):
        head = F.substring(v, 1, most)
        stop = F.regexp_extract(head, r"(?s)^(.*\.) ", 1)
        return F.when(F.length(v) <= most, v).otherwise(F.rtrim(F.when(F.length(stop) > 181, stop).otherwise(head)))

    return let(let(clean, cut), lambda v: F.concat(F.upper(F.substring(v, 1, 1)), F.substr(v, F.lit(2))))


def _replaced(text: Column, rules: dict[str, str], first_alone: bool) -> Column:
    if not first_alone:
        for pattern, value in rules.items():
            text = F.regexp_replace(text, "(?iU)" + pattern, value)
        return text
    out = text
    for pattern, value in reversed(rules.items()):
        out = F.when(text.rlike("(?iU)" + pattern), F.regexp_replace(text, "(?iU)" + pattern, value)).otherwise(out)
    return out


def target_number(text: Column) -> Column:
    found = F.regexp_extract(text, TARGET, 1)
    return F.when(found == "", NO_TARGET).otherwise(found)


def organisation(text: Column) -> Column:
    """The last line of over five characters before the decree's number (without one, of the first 800 characters)."""
    head = F.when(text.rlike(TARGET), _before(text, TARGET)).otherwise(F.substring(text, 1, 800))
    lines = F.filter(F.transform(F.split(head, r"\R"), _plain), lambda x: F.length(x) > 5)
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.when(text.isNotNull(), NO_ORGANISATION))


def objective(text: Column) -> Column:
    """What the decree is for: the title between its number and its date, as an infinitive."""
    title = F.regexp_replace(sentence(_before(_after(text, TARGET), DATE_LINE), 520), DOCUMENT_CODE, "")
    value = F.rtrim(_replaced(title, OBJECTIVES, first_alone=False), F.lit(". "))
    lower = let(value, lambda v: F.concat(F.lower(F.substring(v, 1, 1)), F.substr(v, F.lit(2))))
    return F.coalesce(lower, F.when(text.isNotNull(), NO_OBJECTIVE))


def top_by_terms(items: Column, terms: Sequence[str] = PRIORITY, most: int = 8) -> Column:
    """The items with most of the terms (ties: the earlier), in their own order."""
    hits = lambda x: F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.lower(x).contains(t)))
    ranked = F.array_sort(F.transform(items, lambda x, i: F.struct((-hits(x)).alias("h"), i.alias("i"), x.alias("x"))))
    kept = F.array_sort(F.transform(F.slice(ranked, 1, most), lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x"))))
    return F.transform(kept, lambda r: r["x"])


def considerations(text: Column) -> Column:
    """The eight weightiest grounds; without any the files at VISTO, else what stands before the first article."""
    body = _before(_after(text, r"(?iU)CONSIDERANDO\s*:? ?"), SECTION_END)
    parts = F.split(F.concat(F.lit("\n"), body), r"(?iU)\n\s*Que\s+")
    grounds = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda s: sentence(s)), lambda s: F.length(s) >= 35)
    seen = sentence(_before(_after(text, r"(?iU)\bVISTO\s*:?[ \t]*"), VISTO_END), 900)
    rest = sentence(_before(F.coalesce(_after(text, DATE_LINE), text), FACT_END), 900)
    one = lambda v, lead: F.when(F.coalesce(v, F.lit("")) != "", F.array(F.concat(F.lit(lead), v)))
    other = F.coalesce(one(seen, VISTO_FACT), one(rest, OTHER_FACT), F.when(text.isNotNull(), _none()))
    top = top_by_terms(F.array_distinct(F.coalesce(grounds, _none())))
    return let(top, lambda best: F.when(F.size(best) > 0, best).otherwise(other))


def operative_requirements(text: Column, most: int = 6) -> Column:
    """The first articles that decide something, each as an instruction."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(PROMPT_ARTICLE), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(PROMPT_ARTICLE), F.lit(2)).alias("t"))
    said = F.filter(F.transform(found, lambda x: F.struct(x["n"].alias("n"), sentence(x["t"], 420).alias("t"))), lambda x: (x["t"] != "") & ~x["t"].rlike(FORMAL))
    told = F.transform(said, lambda x: F.concat(F.lit("Artículo funcional "), x["n"], F.lit(": "), _replaced(x["t"], REQUIREMENTS, first_alone=True)))
    return F.slice(told, 1, most)


def redact_target(value: Column, target: Column) -> Column:
    """The decree's own number, with the year whole or in two digits, gives way to a neutral name."""
    number, year = F.substring_index(target, "/", 1), F.right(F.substring_index(target, "/", -1), F.lit(2))
    names = F.concat(F.lit(r"(?iU)\bDecreto\s+(?:N[º°o.]\s*)?(?:"), target, F.lit("|"), number, F.lit("/"), year, F.lit(r")\b"))
    return F.when(target == NO_TARGET, value).otherwise(F.regexp_replace(value, names, F.lit(REDACTED)))


def prompt_parts(text: Column) -> dict[str, Column]:
    """target, organisation, objective, facts, requirements; the target's number is redacted from the last three."""
    target = target_number(text)
    each = lambda items: let(target, lambda own: F.transform(items, lambda x: redact_target(x, own)))
    return {"target": target, "organisation": organisation(text), "objective": redact_target(objective(text), target), "facts": each(considerations(text)), "requirements": each(operative_requirements(text))}


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """{{name}} gives way to its value; unknown names stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), value.cast("string"))
    return template
