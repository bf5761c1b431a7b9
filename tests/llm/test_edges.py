"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, language, mpeg, ngrams, packing, rollups, simhash, toxicity, urls, wrappers
from larkspur.shared import shared_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, label string, length long, pos int"
LONG = "the quick brown fox jumps over a lazy dog " * 5000
ROWS = [
    (1, "the cat sat on the mat and the dog sat on the log", "en", "a", 1, 0.5, "x", "l", 1, 1),
    (2, "the cat sat on the mat and the dog sat on the log", "en", None, 1, None, "x", "l", 1, 1),
    (2, "the cat sat on the mat and the dog sat on the log", "en", None, 1, None, "x", "l", 1, 1),
    (3, None, "de", "a", None, 0.5, None, None, None, None),
    (4, "", None, "a", 0, 0.5, None, None, None, None),
    (5, "  \n\t ", "fr", "a", 0, 0.5, None, None, None, None),
    (6, LONG, "en", "b", 1, 0.5, "y", "l", 1, 1),
    (None, "der hund und die katze sitzen auf der matte", "de", "b", 1, 0.5, "y", "l", 1, 1),
    (7, "der hund und die katze sitzen auf der matte", "de", "b", 1, 0.5, "y", "l", 1, 1),
    (8, "12345 ... !!!", "en", "b", 1, 0.5, "y", "l", 1, 1),
    (9, "日本語 ́ \U0001d4b3 <|endoftext|> İ", "en", "b", 1, 0.5, "y", "l", 1, 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (6, None, 1), (7, 0, 1), (None, 1, 1), (7, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_packing(docs, none):
    got = packing.pack(docs).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert sum(r.doc_id == 2 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    assert [r.length for r in got if r.doc_id in (3, 4, 5)] == [1, 1, 1]
    assert sum(r.length for r in got if r.doc_id == 6) > 40_000 and max(r.length for r in got) == 4096
    assert packing.pack(none).collect() == []


def test_language(docs, none, spark):
    parser = language.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, parser).collect()}
    assert got[1][0] == "en" and got[7][0] == "de" and got[None][0] == "de"
    assert [got[i] for i in (3, 4, 5, 8)] == [("und", 0.0)] * 4
    assert language.identify(docs, parser).count() == len(ROWS)
    assert language.identify(none, parser).collect() == []
    empty = language.fit(none)
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}
    kept = language.accepted(docs, parser)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 6, 7, 9, None}


def test_toxicity(docs, none, labels):
    for fitted in (toxicity.fit_on_fold(docs, labels), toxicity.fit_on_fold(none, labels), toxicity.fit_on_fold(docs, labels.limit(0))):
        got = toxicity.score(docs, fitted).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
        assert toxicity.score(none, fitted).collect() == []
    assert toxicity.accepted(docs, fitted).columns == docs.columns


def test_near_duplicates(docs, none):
    got = rows(simhash.near_duplicates(docs), "doc_id", "component_id", "fingerprint")
    by = {r[0]: r[1:] for r in got}
    assert len(got) == len(ROWS) and by[2][0] == by[1][0] == 1 and by[7][0] == by[None][0] == 7
    assert by[3] == by[4] == by[5] == (3, "0" * 16)
    assert simhash.near_duplicates(none).collect() == []
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 6, 7, 8, 9]


def test_decontamination(docs, none, spark):
    items = spark.createDataFrame([(1, "cat sat on the mat and the dog"), (2, None), (3, ""), (4, "der hund"), (5, "cat sat on the mat and the dog"), (None, "quick brown fox jumps over a lazy dog")], "item_id long, text string")
    got = rows(decontaminate.contained(docs, items), "doc_id", "item_id")
    assert got == sorted([(1, 1), (1, 5), (2, 1), (2, 1), (2, 5), (2, 5), (6, None), (7, 4), (None, 4)], key=repr)
    assert decontaminate.contained(none, items).collect() == [] == decontaminate.contained(docs, items.limit(0)).collect()
    small = decontaminate.contained(docs, items, block_words=3)  # one block an item
    assert rows(small, "doc_id", "item_id") == got
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 8, 9}


def test_media(docs, none):
    got = mpeg.describe(mpeg.media_table(docs)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and by[1].media_sha256 == by[2].media_sha256 and by[1].feature == by[2].feature
    assert (by[3].n_bytes, by[3].payload_bytes) == (0, 64) == (by[4].n_bytes, by[4].payload_bytes)
    assert by[6].n_bytes == len(LONG)
    assert mpeg.describe(mpeg.media_table(none)).collect() == []


def test_language_model(docs, none):
    layout = ngrams.build(docs)
    got = ngrams.score(docs, layout).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and by[3].n_tokens == by[4].n_tokens == by[5].n_tokens == 1
    assert all(r.n_known == r.n_tokens and r.score > r.base_score for r in got if r.doc_id in (1, 2, 6, 7))
    assert by[1].score == by[2].score
    assert ngrams.score(none, layout).collect() == []
    empty = ngrams.score(docs, ngrams.build(none)).collect()
    assert {(r.n_known, r.train_tokens, r.score) for r in empty} == {(0, 0, 0.0)}


def test_rollups(docs, none, spark):
    store = rollups.RollupStore(spark, shared_path(spark, "test-rollups"))
    assert store.totals().collect() == []
    for name, batch in rollups.corpus_changes(docs).items():
        assert store.commit(name, batch)
        assert not store.commit(name, batch)
    got = rows(store.totals(), "source", "lang", "tokenizer", "n_docs")
    assert ("a", "en", "words", 1) in got and not any(r[0] is None for r in got)
    store = rollups.RollupStore(spark, shared_path(spark, "test-rollups"))
    for name, batch in rollups.corpus_changes(none).items():
        assert store.commit(name, batch)
    assert store.totals().collect() == []


def test_pages(spark):
    kind = "page_id long, url string, html string, host string, text string, tokens string, rule string, reference string"
    page = "<html><body><nav><a>menu</a></nav><article><h1>Head &amp; line</h1><p>one  two\nthree<p>four</article><footer>f</footer></body></html>"
    some = [(1, "http://A.example.NET/en/x", page), (1, "http://A.example.NET/en/x", page), (2, None, None), (3, "nothing", ""), (4, "ftp://x.org", "<p>plain"), (None, "http://b.com?q=1#f", "<<<>&#x110000;&bad" + "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, "h", "t", "k", "r", "f") for r in some], kind)
    text = {r.page_id: (r.text, r.n_chars) for r in wrappers.extract(pages).collect()}
    assert text[1] == ("Head & line\none two three\nfour", 30) and text[2] == text[3] == ("", 0) and text[4][0] == "plain" and text[None][0].endswith("deep")
    assert wrappers.extract(pages.limit(0)).collect() == []
    far = {r.page_id: r.text for r in wrappers.extract(pages, broadcast_bytes=0).collect()}
    assert far == {k: v[0] for k, v in text.items()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == got[3] == ("", "", None, "allow")
    assert got[4][:2] == ("x.org", "") and got[None][:2] == ("b.com", "")
    assert urls.judge(pages).count() == len(some) and urls.judge(pages.limit(0)).collect() == []


def test_all_columns_null(spark):
    docs = spark.createDataFrame([(None,) * 10] * 3, DOCS)
    labels = spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int")
    assert packing.pack(docs).count() == 3
    assert simhash.near_duplicates(docs).select(F.count_distinct("fingerprint")).first()[0] == 1
    assert toxicity.score(docs, toxicity.fit_on_fold(docs, labels)).count() == 3
    assert language.identify(docs, language.fit_on_fold(docs)).count() == 3
    assert ngrams.score(docs, ngrams.build_on_fold(docs)).count() == 3
    assert mpeg.describe(mpeg.media_table(docs)).count() == 3
