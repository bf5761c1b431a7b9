"""The rollup store against lost writers, and the pipeline stage by stage."""

import random

import pytest

import corpus_pipeline
from larkspur.llm import decontaminate, language, packing, rollups, simhash, toxicity
from larkspur.shared import shared_path


def changes(spark, rows):
    return spark.createDataFrame(rows, rollups.CHANGES)


def sums(store):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


@pytest.fixture
def path(spark):
    return shared_path(spark, "test-rollups")


def test_a_commit_that_dies_before_its_marker_can_come_again(spark, path, monkeypatch):
    store = rollups.RollupStore(spark, path)
    batch = changes(spark, [(1, "a", "en", "words", 5, "insert"), (2, "a", "en", "words", 7, "insert")])
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("the driver died")))
        with pytest.raises(OSError):
            store.commit("one", batch)
    assert sums(store) == {} and store.commit("one", batch) and not store.commit("one", batch)
    assert sums(store) == {("a", "en", "words"): (2, 12)}


def test_an_unreadable_marker_commits_nothing_and_blocks_nothing(spark, path):
    store = rollups.RollupStore(spark, path)
    assert store.commit("one", changes(spark, [(1, "a", "en", "words", 5, "insert")]))
    for number, content in ((1, b""), (2, b"{\"batch_id\": \"tw")):  # a writer that created its marker and died
        out = store._fs.create(store._at(f"commits/{number:012d}.json"), False)
        out.write(bytearray(content))
        out.close()
    assert store.commit("two", changes(spark, [(1, "a", "en", "words", 6, "revise")]))
    assert sums(store) == {("a", "en", "words"): (1, 6)}
    assert [c["number"] for c in store.commits()] == [0, 3]


def test_two_writers_of_one_number(spark, path):
    one, two = (rollups.RollupStore(spark, path) for _ in range(2))
    before = one.commits()
    assert one.commit("one", changes(spark, [(1, "a", "en", "words", 5, "insert")]))
    two.commits = lambda: before  # saw the same commits
    two._numbers = lambda: []
    with pytest.raises(Exception, match="[Ee]xist"):
        two.commit("two", changes(spark, [(1, "a", "en", "words", 9, "insert")]))
    assert sums(one) == {("a", "en", "words"): (1, 5)}


def test_a_small_batch_reads_its_buckets_only(spark, path):
    store = rollups.RollupStore(spark, path, buckets=16, chain=3)
    store.commit("load", changes(spark, [(i, "a", "en", "words", 1, "insert") for i in range(200)]))
    for n in range(6):
        assert store.commit(f"one {n}", changes(spark, [(7, "a", "en", "words", n, "revise")]))
    touched = store.commits()[-1]["buckets"]
    assert len(touched) == 1 and len(store.entry_files(touched)) <= 3 and len(store.entry_files()) <= 16 + 2
    assert all(f.endswith(f"bucket={touched[0]}") for f in store.entry_files(touched))
    assert sums(store) == {("a", "en", "words"): (200, 204)} and store.entries().where("live").count() == 200


def test_buckets_follow_the_entries(spark, path):
    store = rollups.RollupStore(spark, path, bucket_rows=2)
    assert [store.enough(n) for n in (0, 1, 64, 65, 129, 1000)] == [32, 32, 32, 64, 128, 512]
    assert store.commit("load", changes(spark, [(i, "a", "en", "words", 1, "insert") for i in range(40)])) and store.buckets == 32
    assert store.commit("more", changes(spark, [(i, "b", "en", "words", 2, "insert") for i in range(40, 400)] + [(0, None, None, "words", None, "delete")]))
    before = sums(store)
    assert before == {("a", "en", "words"): (39, 39), ("b", "en", "words"): (360, 720)}
    # the next batch finds 399 entries in 32 buckets for 64 and deals them anew first
    assert store.commit("next", changes(spark, [(1, "a", "en", "words", 5, "revise"), (0, "c", "en", "words", 9, "insert"), (399, None, None, "words", None, "delete")]))
    assert store.buckets == 256 == store.commits()[-1]["of"] and not store.commit("next", changes(spark, [(1, "a", "en", "words", 5, "revise")]))
    want = {("a", "en", "words"): (39, 43), ("b", "en", "words"): (359, 718), ("c", "en", "words"): (1, 9)}
    assert sums(store) == want and store.entries().where("live").count() == 399
    again = rollups.RollupStore(spark, path, bucket_rows=2)
    assert again.buckets == 256 and again.commit("last", changes(spark, [(2, None, None, "words", None, "delete")]))
    assert sums(again)["a", "en", "words"] == (38, 42) and again.entries().where("live").count() == 398


def test_deltas_against_a_dictionary(spark, path):
    rng, store, known = random.Random(3), rollups.RollupStore(spark, path, buckets=4, chain=2, snapshot=3), {}
    for n in range(8):
        rows = {}
        for _ in range(12):
            doc = rng.randint(0, 15)
            rows[doc] = (doc, rng.choice("ab"), rng.choice(["en", None]), "words", rng.randint(0, 9), rng.choice(["insert", "revise", "delete"]))
        store.commit(f"b{n}", changes(spark, list(rows.values())))
        for doc, row in rows.items():
            if row[5] == "delete":
                known.pop(doc, None)
            else:
                known[doc] = row
        want = {}
        for _, source, lang, tokenizer, tokens, _ in known.values():
            docs, total = want.get((source, lang, tokenizer), (0, 0))
            want[source, lang, tokenizer] = (docs + 1, total + tokens)
        assert sums(store) == want


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, fp string"


def corpus():
    rng = random.Random(12)
    words = {"en": "the cat and dog sit on a mat by house tree river stone light green door".split(), "de": "der hund und die katze sitzen auf matte haus baum fluss stein licht tuer".split()}
    rows = []
    for i in range(160):
        lang = "de" if i % 3 == 0 else "en"
        text = " ".join(rng.choices(words[lang], k=rng.randint(30, 60)))
        if i % 8 == 1:
            text += " quux zorgly quux zorgly quux"
        rows.append((i, text, lang, "s", len(text), 0.5, "l", "f"))
    rows += [(200 + i, rows[10 + i][1], "en", "s", 1, None, None, None) for i in range(6)]
    rows += [(300, "stone river " + ITEM + " green door", "en", "s", 1, None, None, None)]
    rows += [(301, None, "en", "s", 1, None, None, None), (302, "", None, None, None, None, None, None), (303, "123 !!!", "en", "s", 1, None, None, None)]
    return rows


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus(), DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("quux" in (r[1] or ""))) for r in corpus()], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_equal_the_operators(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, items = (spark.read.parquet(f"{folder}/{k}.parquet") for k in ("labels", "benchmark"))
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder).cache()
        assert after.columns == docs.columns
        ids, every = {r.doc_id for r in after.collect()}, {r.doc_id for r in docs.collect()}
        if name == "language":
            found = {r.doc_id for r in language.identify(docs, language.fit_on_fold(docs)).collect() if r.lang_pred != "und"}
            assert ids <= found and {301, 302, 303} & ids == set() and len(ids) >= 160
        elif name == "toxicity":
            found = {r.doc_id for r in toxicity.score(docs, toxicity.fit_on_fold(docs, labels)).collect() if not r.predicted}
            assert ids == found and not any("quux" in r.text for r in after.collect())
        elif name == "near-dedup":
            assert ids == {r.component_id for r in simhash.near_duplicates(docs).collect()} and not ids & set(range(200, 206))
        else:
            assert every - ids == {r.doc_id for r in decontaminate.contained(docs, items).collect()} == {300}
        kept[name], docs = ids, after
    want = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.pack(docs).collect()}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in got} == want and {r.doc_id for r in got} == kept["decontamination"]


def test_pipeline_of_nothing(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    spark.createDataFrame([(None,) * 8] * 3, DOCS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
