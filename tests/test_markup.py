"""Visible text against the standard library's parser, on malformed pages and all given ones."""

import random
import time
from html.parser import HTMLParser

import duckdb
from pyspark.sql import functions as F

from glosswork.functions import markup
from glosswork.plans import ORACLES, QUERIES


class Shown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, name, _):
        self.hidden += name in markup.IGNORED
        if name in markup.BLOCKS and not self.hidden:
            self.out.append("\n")

    def handle_endtag(self, name):
        if name in markup.IGNORED and self.hidden:
            self.hidden -= 1
        elif name in markup.BLOCKS and not self.hidden:
            self.out.append("\n")

    def handle_data(self, data):
        self.out += [] if self.hidden else [data]


def parsed(page):
    parser = Shown()
    parser.feed(page)
    parser.close()
    return "".join(parser.out)


PARTS = (
    '<p>|</p>|<div class="a>b">|<br/>|<br>|text |&amp;|&nbsp;|&eacute;|&#233;|&#x41;|&bogus;|&lt|<script>|if (a<b) {}|</script>|<style>|</style>|<head>|</head>|<nav>|</nav>|'
    "<!-- c -->|<!--|-->|<|> |a < b|<!DOCTYPE html>|<?php x ?>|<a href='x>y'>|</a>|<h1|</h1 >|<LI>|</LI>|<b/>|<div/>|<nav/>|</ p>|</>|<1>|é|<template>|</template>|<footer>|</footer>"
).split("|") + [" \n", '<p a="', '"', "'"]


def test_malformed_pages():
    rng = random.Random(8)
    for _ in range(30_000):
        page = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 9)))
        assert markup.visible(page) == parsed(page), page


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("html", markup.visible_text()(F.col("html")).alias("v")).collect()
    assert pages and all(r.v == markup.squashed(parsed(r.html)) for r in pages)


def test_time_is_linear():
    for page in ("<" * 300_000, '<p a="' * 100_000, "<!--" * 100_000, "<!--" * 100_000 + ">", "</" * 200_000, "<a " * 100_000, "<p a='x>" * 50_000, "<script>" * 50_000, "&" * 300_000):
        began = time.time()
        markup.visible(page)
        assert time.time() - began < 10
    assert markup.squashed(markup.visible("")) == ""


def test_references_without_semicolon_as_in_sql(spark, tmp_path):
    pages = ["<p>a &amp;&amp b&amp</p>", "&lt;x&gt &nbsp;&nbsp &quot;&quot &#39;&#39 &ampx; &am", "<p>&amp;amp; &amp;lt;</p>", "&bogus; &;&#;&#x;", ""]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES["s04_html_walked"](spark, str(tmp_path)).select("page_id", "n_chars", "digest").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLES["s04_html_walked"]).fetchall())
    assert markup.visible("&eacute; &eacute &#233; &#x41;", unclosed=False) == "é &eacute é A"
    assert markup.visible("&eacute; &eacute") == "é é"
