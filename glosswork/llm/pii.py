"""Personal data by bootstrapped contextual extraction.

Seeds are the matches of four fixed patterns (e-mail, IP, card, phone) and of
strict shapes of secrets (hexadecimal keys, tokens with a known prefix). Each
seed and each other identifier-like token is an instance; what stands before it
(its last word or last two words with the marks between) and after it are its
lexical patterns. Patterns and instances form a bipartite graph. Each round

* scores a pattern for a kind by the weight of its known instances of that kind
  over that of all its known instances and half its unknown ones,
* scores an unknown instance by the chance that not all of its trusted patterns
  err, and makes it known where that and its form allow.

What became known supports new patterns, so rounds go on until none is found.
Trusted patterns then name the kind of the unseen tokens that they surround.
Everything is DataFrame expressions; the graph holds identifier-like tokens
alone, a small share of the text.

Positions come from cutting a text at a pattern's matches: the pieces and the
matches alternate, so running sums of their lengths are the matches' places.
Running sums and extremes are taken by doubling steps, overlaps by one sort, and
redaction cuts the text from blocks: the time is n log n in the matches of a text.

Each pattern here finds exactly what the stated one finds, written so that it
takes linear time and no recursion: a run of digits or name characters is
entered at its start (or where the last match ended) and taken whole, which is
what the leftmost greedy match does because the next character must differ.

Defined cases: null text counts as empty; matches that fail their check are
dropped and not tried again; a found token that overlaps a seed adds nothing;
spans that overlap are redacted as one, under the kind of the first; rows that
repeat id and text share one result; an empty table gives no rows; columns of
any name pass through redact() untouched but for text and n_chars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.text import let
from glosswork.llm.common import materialize, table, text_of

#: Kinds whose spans the base columns hold, and all.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # Forms of keys and access tokens that their issuers publish.
    "secret": r"(?<![A-Za-z0-9_-])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,64})(?![A-Za-z0-9_-])",
}
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "@", "ip": ".", "card": "[0-9]", "phone": "+", "secret": "[0-9]", "token": "[0-9@]"}
#: An identifier-like token: a run with a digit or @; groups of digits may go on after a space.
TOKEN = (
    r"(?<![\p{L}0-9+@.()_%-])[A-Za-z0-9+(][A-Za-z0-9+@.()_%-]*[0-9@](?:[A-Za-z0-9+@.()_%-]*[A-Za-z0-9)])?+"
    r"(?:(?<=[0-9)]) (?=[0-9(])[0-9().-]*[0-9)])*+"
)
#: Least and most characters of such a token, and least digits where it has no @.
TOKEN_CHARS, TOKEN_MOST, TOKEN_DIGITS = 6, 128, 4
#: Characters beside an instance that patterns are made of.
CONTEXT = 48
#: Distinct known instances and confidence that a pattern needs, confidence that an instance needs.
SUPPORT, CONFIDENCE = 4, 0.8

_SPAN = "struct<start:int,stop:int,token:string,before:string,after:string>"
_NO_SPANS = f"cast(array() as array<{_SPAN}>)"
_MARK = "struct<start:int,stop:int,kind:string>"
_NO_MARKS = f"cast(array() as array<{_MARK}>)"
_FAR = 2_147_483_647
#: Characters of a block that a text is cut from.
_BLOCK = 512


def running(values: Column, combine) -> Column:
    """values[0] combined with all up to each place, by doubling steps."""
    shifts = F.array(*(F.lit(1 << k) for k in range(31)))

    def scan(v):
        step = lambda acc, s: F.transform(acc, lambda x, i: F.when(i >= s, combine(x, F.get(acc, i - s))).otherwise(x))
        return F.aggregate(F.filter(shifts, lambda s: s < F.size(v)), v, step)

    return let(values, scan)


def _matches(text: Column, pattern: str, need: str) -> Column:
    """array<struct<start, stop, token, before, after>> of all matches, in order."""

    def spans(pieces, found):
        lengths = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.length(m) + F.length(p))
        return let(
            running(lengths, lambda a, b: a + b),
            lambda stops: F.transform(
                found,
                lambda m, i: F.struct(
                    (F.get(stops, i) - F.length(m)).alias("start"),
                    F.get(stops, i).alias("stop"),
                    m.alias("token"),
                    F.substring(F.get(pieces, i), -CONTEXT, CONTEXT).alias("before"),
                    F.substring(F.get(pieces, i + 1), 1, CONTEXT).alias("after"),
                ),
            ),
        )

    cut = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    wanted = text.contains(need) if len(need) == 1 else text.rlike(need)
    return F.when(wanted, let(cut, lambda c: spans(c["pieces"], c["found"]))).otherwise(F.expr(_NO_SPANS))


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, token: Column) -> Column:
    if kind == "ip":
        short = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        last = lambda p: F.right(F.lpad(p, F.greatest(F.length(p), F.lit(3)), F.lit("0")), F.lit(3))
        value = lambda p: F.coalesce(F.try_to_number(last(p), F.lit("999")), F.lit(0))
        return F.forall(F.split(token, r"\."), lambda p: short(p) & (value(p) <= 255))
    if kind == "card":
        return let(_digits(token), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(token)).between(8, 15)
    if kind == "secret":
        return token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    return F.lit(True)


def _fits(kind: Column, token: Column) -> Column:
    """Whether an unseen token has a form that the kind allows."""
    digits = F.length(_digits(token))
    numeric = ~token.rlike("[A-Za-z@]")
    return (
        F.when(kind == "email", token.contains("@"))
        .when(kind == "ip", token.contains(".") & numeric & (digits >= 4))
        .when(kind == "card", numeric & digits.between(12, 19))
        .when(kind == "phone", numeric & digits.between(7, 15))
        .otherwise((F.length(token) >= 12) & (digits >= TOKEN_DIGITS) & ~token.rlike("[ @]"))
    )


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(_matches(text, PATTERNS[kind], NEEDS[kind]), lambda s: _valid(kind, s["token"]))


def _apart(tokens: Column, seeds: Column) -> Column:
    """The tokens that overlap no seed: one sort, then the furthest end of seeds
    before each and the nearest start after it."""

    def keep(marks):
        reach = running(F.transform(marks, lambda m: F.when(m["i"] == 0, m["stop"]).otherwise(0)), F.greatest)
        ahead = F.reverse(running(F.reverse(F.transform(marks, lambda m: F.when(m["i"] == 0, m["start"]).otherwise(_FAR))), F.least))
        free = lambda z: (z["marks"]["i"] > 0) & (z["reach"] <= z["marks"]["start"]) & (z["ahead"] >= z["marks"]["stop"])
        zipped = F.arrays_zip(marks.alias("marks"), reach.alias("reach"), ahead.alias("ahead"))
        return F.transform(F.filter(zipped, free), lambda z: F.get(tokens, z["marks"]["i"] - 1))

    mark = lambda s, i: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), i.alias("i"))
    marks = F.array_sort(F.concat(F.transform(seeds, lambda s: mark(s, F.lit(0))), F.transform(tokens, lambda t, i: mark(t, i + 1))))
    return F.when((F.size(seeds) == 0) | (F.size(tokens) == 0), tokens).otherwise(let(marks, keep))


def _contexts(span: Column) -> Column:
    """The lexical patterns around a span: the last word, the last two words, and
    what follows, each with the marks that stand between; without digits."""
    before, after = F.lower(span["before"]), F.lower(span["after"])
    one = F.regexp_extract(before, r"(\p{L}++[^\p{L}0-9\n]*)$", 1)
    two = F.regexp_extract(before, r"(\p{L}++[^\p{L}0-9\n]++\p{L}++[^\p{L}0-9\n]*)$", 1)
    follow = F.regexp_extract(after, r"^([^\p{L}0-9\n]*\p{L}+)", 1)
    named = F.array(F.concat(F.lit("1<"), one), F.concat(F.lit("2<"), two), F.concat(F.lit("1>"), follow))
    return F.filter(named, lambda c: F.length(c) > 2)


def _row_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), text))


def instances(docs: DataFrame) -> DataFrame:
    """key, doc_id, seeds (one array a kind, named as the kind), tokens (not overlapping a seed)."""
    rows = text_of(docs).select(
        _row_key(F.col("doc_id"), F.col("text")).alias("key"),
        "doc_id",
        *(base_spans(F.col("text"), k).alias(k) for k in KINDS),
        F.filter(_matches(F.col("text"), TOKEN, NEEDS["token"]), _identifier).alias("tokens"),
    )
    return rows.withColumn("tokens", _apart(F.col("tokens"), F.concat(*KINDS)))


def _identifier(t: Column) -> Column:
    enough = (F.length(_digits(t["token"])) >= TOKEN_DIGITS) | t["token"].contains("@")
    return F.length(t["token"]).between(TOKEN_CHARS, TOKEN_MOST) & enough


def edges(rows: DataFrame) -> DataFrame:
    """context, token, seed (its kind, null if unknown): distinct, from instances()."""
    own = lambda c: F.explode(F.transform(F.col(c), lambda s: F.struct(s["token"].alias("token"), _contexts(s).alias("contexts"))))
    parts = [rows.select(own(k).alias("s"), F.lit(k).alias("seed")) for k in KINDS]
    found = rows.select(own("tokens").alias("s"), F.lit(None).cast("string").alias("seed"))
    for part in parts:
        found = found.unionByName(part)
    found = found.select(F.explode("s.contexts").alias("context"), F.col("s.token").alias("token"), "seed")
    return found.groupBy("context", "token").agg(F.max("seed").alias("seed"))


def learn(graph: DataFrame) -> tuple[DataFrame, int]:
    """(context, kind) of the patterns that are trusted in the end, and the rounds that found something."""
    graph = materialize(graph, "edges")
    unknown = graph.where("seed is null").select("context", "token")
    known = graph.where("seed is not null").select("token", F.col("seed").alias("kind")).distinct().withColumn("weight", F.lit(1.0))
    rounds = 0
    while True:
        known = materialize(known, "known")
        held = graph.join(known.select(F.col("token").alias("_token"), "kind", "weight"), F.col("token") == F.col("_token"), "left")
        sums = held.groupBy("context", "kind").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
        totals = sums.groupBy("context").agg(
            F.sum(F.coalesce("weight", F.col("n") / 2)).alias("all"),
            F.max_by(F.struct("kind", "weight", "n"), F.struct("weight", "kind")).alias("best"),
        )
        trusted = totals.where(F.col("best.kind").isNotNull() & (F.col("best.n") >= SUPPORT))
        trusted = trusted.select(F.col("context").alias("_context"), F.col("best.kind").alias("kind"), (F.col("best.weight") / F.col("all")).alias("confidence"))
        trusted = materialize(trusted.where(F.col("confidence") >= CONFIDENCE), "trusted")
        new = unknown.join(trusted, F.col("context") == F.col("_context")).where(_fits(F.col("kind"), F.col("token")))
        new = new.groupBy("token", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999999)))))).alias("weight"))
        new = new.groupBy("token").agg(F.max_by(F.struct("kind", "weight"), F.struct("weight", "kind")).alias("best")).select("token", "best.kind", "best.weight")
        new = materialize(new.where(F.col("weight") >= CONFIDENCE).join(known.select("token"), "token", "left_anti"), "new")
        if new.isEmpty():
            return trusted.select(F.col("_context").alias("context"), "kind", "confidence"), rounds
        known, rounds = known.unionByName(new), rounds + 1


def added_spans(rows: DataFrame) -> DataFrame:
    """key, added: array<struct<start, stop, kind>> of what the patterns find."""
    trusted, _ = learn(edges(rows))
    found = rows.where(F.size("tokens") > 0).select("key", F.explode("tokens").alias("t"))
    found = found.select("key", "t.start", "t.stop", "t.token", F.explode(_contexts(F.col("t"))).alias("context"))
    named = found.join(trusted, "context").where(_fits(F.col("kind"), F.col("token")))
    named = named.groupBy("key", "start", "stop").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    return named.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("added"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans per kind, added: every row's seeds and what the patterns add."""
    rows = materialize(instances(docs), "instances")
    added = added_spans(rows).withColumnRenamed("key", "_key")
    return rows.join(added, rows["key"] == F.col("_key"), "left").select("doc_id", *KINDS, F.coalesce("added", F.expr(_NO_MARKS)).alias("added"))


def _listed(spans: dict[str, Column]) -> Column:
    """kind:start:end of spans (start, stop), by kind as given, then start."""

    def lines(kind, own):
        return F.transform(own, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["stop"]))

    return F.array_join(F.concat(*(lines(k, own) for k, own in spans.items())), ",")


def _marks(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def _of(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def digest(found: DataFrame) -> DataFrame:
    place = lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))
    base = {k: F.transform(F.col(k), place) for k in KINDS}
    more = {k: F.transform(_of(F.col("added"), k), place) for k in KINDS}
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_listed({k: base[k] for k in BASE}), 256).alias("base_sha256"),
        _listed({k: F.array_sort(F.concat(base[k], more[k])) for k in KINDS}).alias("spans"),
        F.size("secret").cast("long").alias("n_secret"),
        F.size("added").cast("long").alias("n_added"),
        (sum((F.size(k) for k in KINDS[1:]), F.size(KINDS[0])) + F.size("added")).cast("long").alias("n_spans"),
    )


def _redacted(text: Column, marks: Column) -> Column:
    """text with [KIND] in place of every group of overlapping marks."""

    def cut(blocks, start, stop):
        first = F.floor(start / _BLOCK).cast("int")
        last = F.floor((stop - 1) / _BLOCK).cast("int")
        held = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
        return F.when(stop > start, F.substr(held, start - first * _BLOCK + 1, stop - start)).otherwise("")

    def join(s):
        blocks, ends = s["blocks"], s["ends"]
        heads = F.transform(s["marks"], lambda m, i: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), F.when(i > 0, F.get(ends, i - 1)).otherwise(0).alias("end")))
        heads = F.filter(heads, lambda h: h["end"] <= h["start"])
        parts = F.transform(heads, lambda h: F.concat(cut(blocks, h["end"], h["start"]), F.lit("["), F.upper(h["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), cut(blocks, F.element_at(ends, -1), F.length(text)))

    ordered = F.array_sort(marks)
    state = F.struct(
        ordered.alias("marks"),
        running(F.transform(ordered, lambda m: m["stop"]), F.greatest).alias("ends"),
        F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0)).alias("blocks"),
    )
    return let(state, join)


def redact(docs: DataFrame) -> DataFrame:
    """docs with [KIND] in place of every span; n_chars follows the text. Null text stays null."""
    added = added_spans(materialize(instances(docs), "instances")).withColumnRenamed("key", "_key")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    rows = rows.select("_row", text.alias("_text"), _row_key(F.col("_row.doc_id").cast("long"), text).alias("_own"))
    own = F.concat(*(_marks(base_spans(F.col("_text"), k), k) for k in KINDS))
    joined = rows.join(added, F.col("_own") == F.col("_key"), "left").select("_row", "_text", F.concat(own, F.coalesce("added", F.expr(_NO_MARKS))).alias("_marks"))
    clean = F.when(F.size("_marks") == 0, F.col("_row.text")).otherwise(_redacted(F.col("_text"), F.col("_marks")))
    out = joined.select("_row", clean.alias("_clean"))

    def column(name):
        if name == "text":
            return F.col("_clean").alias(name)
        return F.length("_clean").cast("long").alias(name) if name == "n_chars" else F.col("_row")[name].alias(name)

    return out.select(*map(column, docs.columns))


def query(spark, sf_dir):
    return digest(find(table(spark, sf_dir, "documents")))
