"""Fill-in-the-middle against plain cuts, and its chunks against a scan of whole texts."""

import hashlib
import random

import duckdb
import pytest

from glosswork.llm import infill


def cut(doc_id, text, starts):
    """The expected row; starts: where each unit but the first begins."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(starts) + 1 if text else 0
    ends = [0, *starts, len(text)]
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    p, m, s = text[: ends[a]], text[ends[a] : ends[b]], text[ends[b] :]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), out, text


WHITE = " \t\n\v\f\r"
STARTS = {
    "char": lambda t: list(range(1, len(t))),
    "word": lambda t: [i for i in range(1, len(t)) if t[i - 1] in WHITE and t[i] not in WHITE],
    "line": lambda t: [i for i in range(1, len(t)) if t[i - 1] == "\n"],
}
EXTRA = [(100 + i, t) for i, t in enumerate(["<P", "a<P>b", "x<S", "S>y<", "<M", "<<S><", "\n", "\n\n\na\n", " lead", "é😀", "a" * 9000, "ab \n" * 5000, "w" * 1_500_000])]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
@pytest.mark.parametrize("chunk", [1, 7, infill.CHUNK])
def test_against_plain_cuts(docs, unit, chunk, spark):
    extra = spark.createDataFrame(EXTRA, "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), extra):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        got = [tuple(r) for r in infill.fill_in_middle(df, unit, chunk=chunk).collect()]
        assert sorted(got, key=repr) == sorted((cut(i, t, STARTS[unit](t)) for i, t in rows), key=repr)


def test_shares_of_forms(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "'some text' as text")
    forms = [r.form for r in infill.fill_in_middle(df).collect()]
    assert 240 < forms.count("plain") < 360 and 430 < forms.count("spm") < 650
    assert {r.form for r in infill.fill_in_middle(df, plain_percent=0, spm_percent=100).collect()} == {"spm"}
    assert {r.form for r in infill.fill_in_middle(df, plain_percent=100).collect()} == {"plain"}


def test_restore_any_parts():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("<>PSMa") for _ in range(rng.randrange(12)))
        if any(m in text for m in ("<P>", "<S>", "<M>")):
            continue
        a, b = sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))
        for form in ("plain", "psm", "spm"):
            assert infill.restore(infill.arrange(form, text[:a], text[a:b], text[b:]), form) == text


def test_places_of_every_rank():
    texts = ["", "a", "ab cd\n", "  x  y z", "é" * 50 + " k"]
    for unit, starts in STARTS.items():
        for size in (1, 3, 64):
            some = infill.Chunks(texts, unit, size)
            for i, t in enumerate(texts):
                ends = [0, *starts(t), len(t)] if t else [0]
                assert some.units()[i] == len(ends) - 1
                assert [some.place(i, r) for r in range(len(ends))] == ends
    with pytest.raises(ValueError):
        infill.boundaries(some.codes, some.codes, "page")


def test_sql_and_empty(spark, sf_dir, none):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    found = con.execute(infill.SQL)
    names = [d[0] for d in found.description]
    got = infill.query(spark, sf_dir)
    assert names == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())
    assert all(r.restored_sha256 for r in got.collect())
    assert infill.fill_in_middle(none).collect() == []
