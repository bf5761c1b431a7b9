"""Token files against the tokenizers library, and their boundaries against plain lists."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import tokenfiles
from larkspur.llm.packing import vocabulary_path
from larkspur.shared import shared_path

PATH = vocabulary_path("byte_bpe_50k.json")
KIND = "doc_id long, text string, lang string, start long, n_tokens long, place string, part int"


def library(text):
    return tokenfiles._tokenizer(PATH).encode(text, add_special_tokens=False).ids


def ours(texts):
    return [np.frombuffer(b, "<u4").tolist() for b in tokenfiles.UnitEncoder(PATH).encode(texts)]


PIECES = ["the", "Ünïcode", "don't", "'s", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c", "123", "a1b2", "...", "!?", " ", "　", " ", "日本語", "\U0001f600", "é", "\x00", "\x1c", "\x85", "<|endoftext|>", "<|", "'", "x" * 40, "ſ", "İ"]


def test_units_give_the_ids_of_the_library():
    rng = random.Random(4)
    texts = ["", " ", "\n", "a  ", " \n a", "a \t b", "\t  b", "don't  stop\n\n 's"] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    assert ours(texts) == [library(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_any_text(texts):
    assert ours(texts) == [library(t) for t in texts]


def test_long_unusual_texts_are_cut_where_no_unit_is(monkeypatch):
    monkeypatch.setattr(tokenfiles, "LONG", 50)
    rng = random.Random(5)
    for _ in range(200):
        text = " " + "".join(rng.choice(PIECES + ["a b\nc "] * 20) for _ in range(80))
        assert ours([text]) == [library(text)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=900), st.integers(0, 2**50), st.integers(1, 40))
def test_boundaries_are_the_sequence(steps, jump, every):
    values = np.cumsum([s + (jump if i % every == 0 else 0) for i, s in enumerate(steps)] or [0]).astype(np.uint64) // np.uint64(1 + len(steps))
    values.sort()
    made = tokenfiles.Monotone(tokenfiles.Monotone.build(values, int(values[-1]) + 1, "x"), "x")
    assert made.access(np.arange(len(values))).tolist() == values.tolist()
    for v in {0, int(values[-1]), int(values[len(values) // 2])}:
        assert made.upto(v) == int((values <= v).sum())


def test_boundaries_are_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2400, 50_000))
    made = tokenfiles.Monotone.build(ends, int(ends[-1]) + 1, "x")
    assert sum(a.nbytes for a in made.values()) * 8 / len(ends) < 2.4 + np.log2(1200)
    assert not any(k.endswith(("ones", "zeros")) for k in made)


def rows_of(rng, n):
    words = ["alpha", "beta\n", "gamma's", "  delta", " ", "ε", "<|endoftext|>"]
    rows = [(rng.choice([None, rng.randint(-5, 400), -(2**63), 2**63 - 1]) if i % 9 == 0 else i, rng.choice([None, ""]) if i % 11 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return rows + [(77, "hot " * 5)] * n + [(500, "long text " * 30_000)]


def test_store_reads_back_what_the_library_says(spark):
    rows = rows_of(random.Random(6), 150)
    docs = spark.createDataFrame([(*r, "x", 1, 2, "p", 3) for r in rows], KIND).repartition(6)
    store = tokenfiles.TokenStore.write(docs, shared_path(spark, "tokens"), file_tokens=1000)
    got = sorted(store.documents(spark).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and store.files(spark).count() > 10
    at = 0
    for r in got:  # without gaps, in ascending doc_id order, nulls first
        assert r.start == at
        at += r.n_tokens
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda d: (d is not None, d or 0))
    sums = lambda t: ((ids := np.array([*library(t or ""), 2], "<u4")).size, zlib.crc32(ids.tobytes()))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(((d, *sums(t)) for d, t in rows), key=repr)

    reader = store.reader(spark)
    assert len(reader) == len(rows) and reader.n_tokens == at
    whole = np.concatenate([reader.document(i) for i in range(len(rows))])
    assert (reader.window(0, at + 5) == whole).all() and (reader.window(990, 2500) == whole[990:3490]).all()
    for r in got[::17]:
        i = got.index(r)
        assert reader.document_at(r.start) == i == reader.document_at(r.start + r.n_tokens - 1)
    with pytest.raises(IndexError):
        reader.document(len(rows))


def test_empty_table_and_wide_ids(spark):
    none = tokenfiles.TokenStore.write(spark.createDataFrame([], KIND), shared_path(spark, "tokens"))
    assert none.documents(spark).collect() == [] and none.reader(spark).window(0, 5).size == 0
    docs = spark.createDataFrame([(1, "a b", "x", 1, 2, "p", 3)], KIND)
    (r,) = tokenfiles.tokens_of(docs, shared_path(spark, "tokens"), end_id=70_000).collect()
    assert r.ids_crc32 == zlib.crc32(np.array([*library("a b"), 70_000], "<u4").tobytes())


def test_a_task_that_runs_again_leaves_the_same_file(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "x", 1, 2, "p", 3) for i in range(50)], KIND)
    one, two = (tokenfiles.TokenStore.write(docs, f"file://{tmp_path}/{n}", file_tokens=60) for n in "ab")
    names = [r["name"] for r in one.files(spark).collect()]
    assert names == [r["name"] for r in two.files(spark).collect()]
    assert all((tmp_path / "a" / n).read_bytes() == (tmp_path / "b" / n).read_bytes() for n in names)
