"""Contextual extraction: against a scorer over plain loops, on planted contexts, and on long texts."""

import math
import time
from collections import defaultdict

import pytest
import regex
from brute import base
from pyspark.sql import functions as F

from glosswork.llm import pii

#: A secret's seed in another writing than the operator's.
SECRET = regex.compile(r"(?<![\w-])(?:[0-9a-f]{32}(?:[0-9a-f]{8})?|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,64})(?![\w-])", regex.ASCII)
TOKEN = regex.compile(pii.TOKEN)


def digits(s):
    return sum(c in "0123456789" for c in s)


def contexts(text, lo, hi, before, after):
    """before and after: where the neighbouring tokens of that pattern end and start."""
    left, right = text[before:lo][-48:].lower(), text[hi:after][:48].lower()
    out = []
    for name, pattern, part in (("1<", r"\p{L}++[^\p{L}0-9\n]*$", left), ("2<", r"\p{L}++[^\p{L}0-9\n]++\p{L}++[^\p{L}0-9\n]*$", left), ("1>", r"^[^\p{L}0-9\n]*\p{L}+", right)):
        m = regex.search(pattern, part)
        if m and m[0]:
            out.append(name + m[0])
    return out


def spans_of(pattern, text):
    found = [(m.start(), m.end()) for m in pattern.finditer(text)]
    ends = [0, *(b for _, b in found)]
    starts = [*(a for a, _ in found), len(text)]
    return [(a, b, contexts(text, a, b, ends[i], starts[i + 1])) for i, (a, b) in enumerate(found)]


def fits(kind, t):
    numeric = not regex.search("[A-Za-z@]", t)
    n = digits(t)
    return {"email": "@" in t, "ip": "." in t and numeric and n >= 4, "card": numeric and 12 <= n <= 19, "phone": numeric and 7 <= n <= 15}.get(kind, len(t) >= 12 and n >= 4 and " " not in t and "@" not in t)


def brute(rows, base):
    """Per row (base spans, secrets, added) by the docstring's rules."""
    seeds, tokens = [], []
    for _, text in rows:
        own = {k: [s for s in spans_of(regex.compile(pii.PATTERNS[k]), text) if (s[0], s[1]) in set(base(text)[k])] for k in pii.BASE}
        own["secret"] = [s for s in spans_of(SECRET, text) if digits(text[s[0] : s[1]]) and regex.search("[A-Za-z]", text[s[0] : s[1]])]
        taken = [(a, b) for s in own.values() for a, b, _ in s]
        free = [s for s in spans_of(TOKEN, text) if not any(a < s[1] and s[0] < b for a, b in taken)]
        seeds.append(own)
        tokens.append([s for s in free if 6 <= s[1] - s[0] <= 128 and (digits(text[s[0] : s[1]]) >= 4 or "@" in text[s[0] : s[1]])])
    edge = {}
    for (_, text), own, free in zip(rows, seeds, tokens, strict=True):
        for kind, found in [*own.items(), ("", free)]:
            for a, b, cs in found:
                for c in cs:
                    edge[c, text[a:b]] = max(kind, edge.get((c, text[a:b]), ""))
    known = defaultdict(dict)
    for (_, t), kind in edge.items():
        if kind:
            known[t][kind] = 1.0
    while True:
        total, weight, count = defaultdict(float), defaultdict(float), defaultdict(int)
        for (c, t), _ in edge.items():
            for kind, w in known[t].items() if t in known else ():
                total[c] += w
                weight[c, kind] += w
                count[c, kind] += 1
            total[c] += 0 if t in known else 0.5
        trusted = {}
        for c in total:
            w, kind = max(((weight[c, k], k) for k in pii.KINDS if (c, k) in weight), default=(0, None))
            if kind and count[c, kind] >= pii.SUPPORT and w / total[c] >= pii.CONFIDENCE:
                trusted[c] = (w / total[c], kind)
        doubt = defaultdict(float)
        for (c, t), kind in edge.items():
            if not kind and c in trusted and fits(trusted[c][1], t):
                doubt[t, trusted[c][1]] += math.log1p(-min(trusted[c][0], 0.999999))
        best = {}
        for (t, kind), d in doubt.items():
            best[t] = max(best.get(t, (0, "")), (1 - math.exp(d), kind))
        new = {t: {k: w} for t, (w, k) in best.items() if w >= pii.CONFIDENCE and t not in known}
        if not new:
            break
        known.update(new)
    out = []
    for (_, text), own, free in zip(rows, seeds, tokens, strict=True):
        added = []
        for a, b, cs in free:
            names = [trusted[c] for c in cs if c in trusted and fits(trusted[c][1], text[a:b])]
            if names:
                added.append((max(names)[1], a, b))
        out.append((own, added))
    return out


def lines(own, added):
    spans = [(pii.KINDS.index(k), a, b) for k, found in own.items() for a, b, _ in found] + [(pii.KINDS.index(k), a, b) for k, a, b in added]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


PLANTED = [f"please write to user{i}@mail.example.com today" for i in range(12)]
PLANTED += ["please write to user77[at]mail1234 today", "please write to agent@localhost now", "order number was 12345678 then"]
# Phones of another form stand after "call me at"; those support "desk line", which then finds one more.
PLANTED += [f"call me at +1 (017) 555-77{i:02d} soon" for i in range(20)]
PLANTED += [f"call me at 017 555 88{i:02d} or at desk line 017 555 88{i:02d} soon" for i in range(6)] + ["our desk line 017 666 1234 rings", "lot 017 777 1234 sold"]
PLANTED += [f'password = "{i:02d}ab{"0f1e2d3c4b" * 3}{i:02d}cdef" was set' for i in range(8)] + ['password = "Tr0ub4dor-99-x1" was set', 'version = "2024-01-15-rc12" is out']


def test_spans_against_plain_loops(spark, docs, real):
    planted = spark.createDataFrame(list(enumerate(PLANTED)), "doc_id long, text string")
    some = docs.where("doc_id is null or doc_id not in (10, 11, 12)")
    for df, least in ((planted, 8), (some, 0), (real, 0)):
        rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        expected = sorted(((i, lines(own, added), len(own["secret"]), len(added)) for (i, _), (own, added) in zip(rows, brute(rows, base), strict=True)), key=repr)
        got = sorted(((r.doc_id, r.spans, r.n_secret, r.n_added) for r in pii.digest(pii.find(df)).collect()), key=repr)
        assert got == expected
        assert sum(r[3] for r in got) >= least


def test_bootstrap_goes_beyond_the_first_round(spark):
    rows = spark.createDataFrame(list(enumerate(PLANTED)), "doc_id long, text string")
    got = {PLANTED[r.doc_id]: r for r in pii.digest(pii.find(rows)).collect()}
    _, rounds = pii.learn(pii.edges(pii.instances(rows)))
    assert rounds >= 2  # "desk line" is trusted through what "call me at" found
    assert got["our desk line 017 666 1234 rings"].n_added == 1
    assert got['password = "Tr0ub4dor-99-x1" was set'].n_added == 1
    assert got["please write to agent@localhost now"].spans.startswith("email:")
    assert not any(got[t].n_spans for t in ("lot 017 777 1234 sold", "order number was 12345678 then", 'version = "2024-01-15-rc12" is out'))
    clean = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert clean[PLANTED.index("our desk line 017 666 1234 rings")] == "our desk line [PHONE] rings"
    assert clean[PLANTED.index('password = "Tr0ub4dor-99-x1" was set')] == 'password = "[SECRET]" was set'


def test_added_spans_on_a_larger_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = pii.find(df).where(F.size("added") > 0).select("doc_id", F.explode("added").alias("a")).join(df, "doc_id")
    said = [r.x.lower() for r in found.select(F.expr("substr(text, a.start - 8, 49)").alias("x")).collect()]
    assert said and sum(s.startswith('token = "') for s in said) / len(said) >= 0.9
    assert pii.redact(df).where("text rlike 'token = .[0-9a-f]{40}|TOKEN = .[0-9A-F]{40}'").count() == 0


@pytest.mark.parametrize("text", ["7 a " * 250_000, "user1@mail.example.com " * 90_000, "+1 (017) 555-7713, 4845168114407329, 10.0.0.255 x " * 20_000, "1 " * 500_000, "a.b" * 300_000])
def test_long_texts_take_linear_time(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (row,) = pii.digest(pii.find(df)).collect()
    middle = time.time()
    (clean,) = pii.redact(df).collect()
    assert middle - began < 40 and time.time() - middle < 40  # seconds even of a slow machine; it was hours
    n = 20_000 if text.startswith("+") else 0
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (90_000 if "@" in text else 0, n, n, n)
    if n:
        assert clean.text == "[PHONE], [CARD], [IP] x " * n


def test_redact_of_overlaps_and_clashing_columns(spark, none):
    text = "a 4845 1681 1440 7329@x.com b +1 4845168114407329 c"
    rows = spark.createDataFrame([(1, text, "added", "key", "own", "row", "spans", "text")], "doc_id long, text string, added string, _key string, _own string, _row string, _spans string, _text string")
    (got,) = pii.redact(rows).collect()
    assert got.text == "a [CARD] b +1 4845168114407329 c"  # with the 1 before it the number has 17 digits and fails its check
    assert tuple(got)[2:] == ("added", "key", "own", "row", "spans", "text")
    assert pii.redact(none).count() == 0 and pii.redact(none).columns == none.columns
