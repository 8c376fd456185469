import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, norm string, fp string, sha string, item string"

LONG = "word " * 30_000
ROWS = [
    (1, "Alpha Beta gamma delta epsilon zeta", "en"),
    (2, "ALPHA beta gamma delta epsilon zeta", "en"),
    (3, "ÄLPHA É ß Übung für Größe ÉCOLE", "de"),
    (4, "älpha É ß übung für größe École", "de"),
    (5, None, None),
    (6, "", "en"),
    (6, "", "en"),
    (7, "mail a.b+c@x-y.example.com or +1 (017) 555-7713, ip 10.0.0.255 bad 1.2.3.256 00001.02.3.4", None),
    (8, "card 4845168114407329 and 4845 1681 1440 7329 and 4845168114407328 \n  two  spaces \t tab", "en"),
    (9, LONG, "en"),
    (10, LONG + "end", "en"),
    (11, "x" * 20_000, "en"),
    (12, "1" * 9_000 + " " + "a.b" * 5_000, "en"),
    (13, "tail \n <|endoftext|> mark <|startoftext|>\n ", "en"),
    (14, "ΑΣ İstanbul \u0065\u0301 \x1c \x85 \u00a0 日本語 😀", "xx"),
    (15, "a@b.cd_x@y.z 1.2.3.4.5.6.7.8 @@ a@b a@b. + +1 +12345678 (1)", "en"),
    (None, "no identifier", "en"),
    (17, "Licensed under the Apache License, Version 2.0. Some more! RELEASED!! UNDER!! THE!! MIT!! LICENSE.\nAll rights reserved", "en"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, lang, "src", 0 if t is None else len(t), "clash", "clash", "clash", "clash") for i, t, lang in ROWS]
    return spark.createDataFrame(rows, KINDS).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id < 0")


@pytest.fixture(scope="session")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
