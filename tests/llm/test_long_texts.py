"""Every operator over documents on very long texts of one character or one line after another."""

import public_tokenizers as P
import pytest
from test_licenses import brute
from tokenizers import Tokenizer

from glosswork.llm import bpe, exact_dedup, infill, licenses, media, near_copies, packing, pii, quality, secret_layers, simhash, token_files

SIZE = 1_200_000
BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
TEXTS = [
    " " * SIZE, "\n" * SIZE, "7" * SIZE, "w" * SIZE, "a@" * (SIZE // 2), "1 " * (SIZE // 2), " \n" * (SIZE // 2), "é" * SIZE,
    ("\n\n".join(licenses.APACHE) + "\n\n") * 3000, ("\n".join(licenses.BSD[:3]) + "\n") * 3000,
]


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def test_licences(long):
    got = {r.doc_id: (r.n_sentences, r.sentence_ids, r.licenses, r.verdict) for r in licenses.scan(long).collect()}
    for i, text in enumerate(TEXTS):
        if i not in (1, 6, 8, 9):
            assert got[i][1:] == ("", "", "none")
    assert got[8][2] == "apache-2.0" and got[8][1].count(",") == 15_000 - 1
    assert got[9][2] == "bsd-2-clause"
    short = ("\n".join(licenses.BSD[:3]) + "\n") * 3
    (few,) = licenses.scan(long.sparkSession.createDataFrame([(0, short)], "doc_id long, text string")).collect()
    assert (few.n_sentences, few.sentence_ids, few.licenses, few.verdict) == brute(short)


@pytest.mark.parametrize("path, make", [(BYTES, bpe.bulk_encoder), (WORDS, bpe.word_encoder)])
def test_encoders(path, make):
    library = Tokenizer.from_file(path)
    for text in TEXTS[:8]:
        (ids,) = make(path).encode_many([text])
        assert memoryview(ids).cast("I").tolist() == library.encode(text, add_special_tokens=False).ids


RUNS = {
    "packing": lambda d: packing.pack(d, BYTES),
    "bpe": lambda d: bpe.digests(d, BYTES),
    "exact": exact_dedup.content_sort,
    "pii": pii.redact,
    "simhash": simhash.near_duplicates,
    "near": near_copies.keep_first,
    "media": lambda d: media.digest(media.media_columns(d)),
    "tokens": lambda d: token_files.write_and_read(d, WORDS, 1),
    "secrets": secret_layers.find_secrets,
    "infill": infill.fill_in_middle,
}


@pytest.mark.parametrize("name", RUNS)
def test_operators(long, name):
    rows = RUNS[name](long)
    assert {r.doc_id for r in rows.select("doc_id").collect()} <= set(range(len(TEXTS)))
    assert rows.count() >= len(TEXTS) - 3


def test_quality(long, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id >= 10").unionByName(long)
    assert quality.keep_good(docs, labels).count() > 0
