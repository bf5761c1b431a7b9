"""Indexes against scoring everything in plain Python."""

import random
import re
from math import log

import numpy as np
import pyarrow as pa
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from larkspur.operators import textindex, vectorindex, vectors
from larkspur.operators.late import LateIndex
from larkspur.operators.textindex import TextIndex
from larkspur.operators.vectorindex import VectorIndex
from larkspur.shared import shared_path


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def bm25(docs, queries, k):
    terms = {i: words(t) for i, t in docs.items()}
    n, mean = len(docs), sum(map(len, terms.values())) / max(len(docs), 1)
    df = {}
    for own in terms.values():
        for w in set(own):
            df[w] = df.get(w, 0) + 1
    out = []
    for q, text in queries.items():
        asked, hits = set(words(text)), []
        for i, own in terms.items():
            held = [w for w in asked if w in own]
            score = sum(log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * own.count(w) * 2.2 / (own.count(w) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w in held)
            if held:
                hits.append((-round(score, 9), i))
        out += [(q, i, round(-s, 4), r) for r, (s, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out)


def found(index, spark, queries, k=3, **options):
    asked = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    return sorted((r.query_id, r.id, r.score, r["rank"]) for r in index.search(asked, k, **options).collect())


VOCABULARY = [f"w{i}" for i in range(60)]


def texts(rng, n, start=0):
    return {start + i: rng.choice([None, ""]) if rng.random() < 0.05 else " ".join(rng.choices(VOCABULARY, [1 / (r + 1) for r in range(60)], k=rng.randint(1, 40))) for i in range(n)}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], "id long, text string, term string, tf int")


QUERIES = {1: "w0 w1 w50", 2: "w59 w58", 3: "nowhere", 4: "W3 w3 w7, w9", 5: None, 6: " ".join(VOCABULARY)}


def test_ranges_and_bounds_lose_no_hit(spark):
    docs = texts(random.Random(1), 500)
    index = TextIndex(spark, shared_path(spark, "test-text"), block=4)
    index.apply(frame(spark, docs).unionAll(frame(spark, docs)))  # rows of an id count once
    for k, first in ((1, 1), (3, 2), (20, 5), (1000, 8)):
        assert found(index, spark, QUERIES, k, first=first) == bm25(docs, QUERIES, k)
    work = {r.query_id: (r.n_postings, r.n_scored) for r in index.work(spark.createDataFrame([(2, QUERIES[2])], "query_id long, query string"), 3, 2).collect()}
    assert work[2][1] < work[2][0] == sum(w in words(t) for t in docs.values() for w in ("w59", "w58"))


def test_changes_equal_a_rebuild(spark):
    rng, docs = random.Random(2), texts(random.Random(3), 80)
    index = TextIndex(spark, shared_path(spark, "test-text"), block=4, segments=3)
    assert found(index, spark, QUERIES) == []
    numbers = [index.apply(frame(spark, docs))]
    for step in range(4):
        before = dict(docs)
        for i in rng.sample(sorted(docs), 12):
            del docs[i]
        docs |= texts(rng, 10, 1000 * (step + 1)) | {i: f"{t} w59 edited" for i, t in docs.items() if i % 9 == step}
        changes = {(r.id, r.op) for r in index.changes(frame(spark, docs)).collect()}
        want = {(i, "insert") for i in docs.keys() - before.keys()} | {(i, "delete") for i in before.keys() - docs.keys()}
        assert changes == want | {(i, "edit") for i in docs.keys() & before.keys() if (docs[i] or "") != (before[i] or "")}
        numbers.append(index.refresh(frame(spark, docs)))
        assert found(index, spark, QUERIES, 5) == bm25(docs, QUERIES, 5)
        assert len(index.version()["segments"]) <= 3
    now = found(index, spark, QUERIES, 5)
    index.rollback(numbers[0])
    assert found(index, spark, QUERIES, 5) == bm25(texts(random.Random(3), 80), QUERIES, 5)
    index.rollback(numbers[-1])
    assert found(index, spark, QUERIES, 5) == now
    index.apply(frame(spark, {}), spark.createDataFrame([(i,) for i in docs], "id long"))
    assert found(index, spark, QUERIES) == [] and index.version()["n"] == 0


def test_a_lost_writer_leaves_the_old_version(spark, monkeypatch):
    docs = texts(random.Random(4), 40)
    index = TextIndex(spark, shared_path(spark, "test-text"))
    index.apply(frame(spark, docs))
    want = bm25(docs, QUERIES, 3)
    with monkeypatch.context() as m:
        m.setattr(index, "_publish", lambda *_: (_ for _ in ()).throw(OSError("the driver died")))
        with pytest.raises(OSError):
            index.apply(frame(spark, {1: "w1 w1 w1"}))
    assert found(index, spark, QUERIES) == want
    # a version that is written but not used, and an alias file that is not whole
    index.versions.add({"segments": []})
    out = index.versions._fs.create(index.versions._at(f"alias/{1:012d}.json"), False)
    out.write(bytearray(b'{"vers'))
    out.close()
    assert found(index, spark, QUERIES) == want
    index.apply(frame(spark, {1: "w1 w1 w1"}))
    assert found(index, spark, QUERIES) == bm25(docs | {1: "w1 w1 w1"}, QUERIES, 3)


def test_one_of_two_writers_fails(spark):
    index = TextIndex(spark, shared_path(spark, "test-text"))
    index.apply(frame(spark, {1: "w1"}))
    seen = index.versions.last()
    index.apply(frame(spark, {2: "w1"}))
    with pytest.raises(Py4JJavaError, match="[Ee]xist"):
        index._publish({"segments": []}, seen)
    assert {r[1] for r in found(index, spark, {1: "w1"})} == {1, 2}


def test_texts_and_postings_stay_in_their_tasks(spark, monkeypatch):
    docs = texts(random.Random(5), 200)
    index = TextIndex(spark, shared_path(spark, "test-text"), block=4)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan(textindex.forward(frame(spark, docs)))
    assert "max(" not in plan(index.changes(frame(spark, docs)))
    for name, small in (("DOCS", 7), ("POSTS", 60), ("PUSHED", 3), ("HELD", 200)):  # many chunks, of few documents or few postings
        monkeypatch.setattr(textindex, name, small)
    index.apply(frame(spark, docs))
    places = spark.read.parquet(f"{index.path}/{index.version()['segments'][0]}/postings").where("term = ''")
    assert places.agg(F.sum("n"), F.max("n")).first() == (200, 7) and places.select("chunk").distinct().count() == places.count() > 200 / 7
    docs = {i: f"{t} w58" if i % 5 == 0 else t for i, t in docs.items() if i % 7} | {1000: None, 1001: "w1 w59"}
    index.refresh(frame(spark, docs))
    assert found(index, spark, QUERIES, 4, first=1) == bm25(docs, QUERIES, 4)
    n = sum(w in words(t) for t in docs.values() for w in ("w59", "w58"))
    assert [tuple(r)[:2] for r in index.work(spark.createDataFrame([(2, QUERIES[2])], "query_id long, query string")).collect()] == [(2, n)]


def vectors_of(spark, rng, n, wide=24):
    centres = rng.normal(0, 1, (12, wide))
    rows = [(i, (centres[i % 12] * (1 if i % 3 else 3) + rng.normal(0, 0.5, wide)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(200)]  # one very common vector
    odd = [(n + 900, None), (n + 901, [1.0, 2.0]), (n + 902, [0.0] * wide)]
    return rows, spark.createDataFrame(rows + odd, "id long, vector array<float>"), n + 902


def cosines(rows, q, zero):
    m = np.array([v for _, v in rows], np.float64)
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    q = np.array(q, np.float64)
    scores = np.round(m @ (q / np.sqrt(q @ q)), 9)
    return sorted([(-s, i) for (i, _), s in zip(rows, scores.tolist())] + [(0.0, zero)])


def test_vector_index(spark):
    rng = np.random.default_rng(3)
    rows, corpus, zero = vectors_of(spark, rng, 1500)
    index = VectorIndex.build(corpus, shared_path(spark, "test-vectors"), cells=30, parts=6, entries=32, sample=400)
    asked = {i: v for i, v in rows[:1000:50]}
    queries = spark.createDataFrame([*asked.items(), (-1, None)], "query_id long, query_vector array<float>")
    for k, block in ((1, 256), (10, 7), (250, 256)):
        got = {}
        for r in index.search(queries, k, probes=2, exact=True, block=block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
        for q, v in asked.items():
            want = cosines(rows, v, zero)[:k]
            assert [i for _, i, _ in sorted(got[q])] == [i for _, i in want]
    near = vectorindex.recall(index.search(queries, 10), index.search(queries, 10, exact=True)).collect()
    assert len(near) == len(asked) and sum(r.recall for r in near) / len(near) >= 0.9
    assert index.code_bytes == 6 and VectorIndex(spark, index.path).sizes.sum() == len(rows) + 1


def test_vector_index_of_little(spark):
    empty = VectorIndex.build(spark.createDataFrame([], "id long, vector array<float>"), shared_path(spark, "test-vectors"))
    assert empty.search(spark.createDataFrame([(1, [1.0])], "query_id long, query_vector array<float>"), 3, exact=True).collect() == []
    one = VectorIndex.build(spark.createDataFrame([(5, [3.0, 4.0])], "id long, vector array<float>"), shared_path(spark, "test-vectors"))
    (r,) = one.search(spark.createDataFrame([(1, [4.0, 3.0])], "query_id long, query_vector array<float>"), 3, exact=True).collect()
    assert (r.id, r.score) == (5, 0.96)


def test_vector_index_joins_no_bounds(spark):
    rng = np.random.default_rng(5)
    corpus = spark.createDataFrame([(i, rng.normal(0, 1, 24).tolist()) for i in range(1200)], "id long, vector array<float>")
    index = VectorIndex.build(corpus, shared_path(spark, "test-vectors"), cells=8, parts=2, entries=2)  # whose bounds hold back little
    queries = corpus.where("id % 50 = 0").selectExpr("id AS query_id", "vector AS query_vector")
    got = index.search(queries, 10, probes=1, oversample=1, exact=True, block=10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" not in plan  # what is left to do is to rank k rows a query
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, vectors.search(queries, corpus, 10).collect()))


def test_late_interaction(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (9, 12))
    docs = {d: [(centres[rng.integers(9)] + rng.normal(0, 0.4, 12)).astype(np.float32) for _ in range(int(rng.integers(1, 9)))] for d in range(300)}
    docs[300] = docs[0] * 200  # a long document of copies
    docs |= {301 + i: docs[1] for i in range(60)}  # many equal documents
    rows = [(d, v.tolist()) for d, own in docs.items() for v in own] + [(7, None), (8, [1.0]), (None, [0.5] * 12), (999, None)]
    tokens = spark.createDataFrame(rows, "doc_id long, vector array<float>").repartition(4)
    index = LateIndex.build(tokens, shared_path(spark, "test-late"), cells=20, sample=500)
    asked = {d: docs[d] for d in range(0, 300, 50)} | {1000: [rng.normal(0, 1, 12).astype(np.float32) for _ in range(4)]}
    queries = spark.createDataFrame([(q, v.tolist()) for q, own in asked.items() for v in own] + [(2000, None)], "query_id long, vector array<float>")

    def unit(own):
        m = np.array(own, np.float64)
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))

    for k, probes, block in ((1, 1, 256), (10, 2, 3), (400, 4, 256)):
        got = {}
        for r in index.search(queries, k, probes, block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
        assert got.keys() == asked.keys()
        for q, own in asked.items():
            want = sorted((-round(float((unit(own) @ unit(held).T).max(axis=1).sum()), 9), d) for d, held in docs.items())[:k]
            assert [i for _, i, _ in sorted(got[q])] == [d for _, d in want]
            assert np.allclose([s for *_, s in sorted(got[q])], [-s for s, _ in want])


def test_nearest_until_rows_are_enough(spark):

    rng = np.random.default_rng(9)
    rows = [(i, rng.choice([-1.0, 0.0, 1.0], 3).tolist(), int(rng.integers(1, 6))) for i in range(200)] + [(900, None, 3), (901, [1.0], 2)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>, n int").repartition(5)
    asked = spark.createDataFrame([(q, rng.normal(0, 1, 3).tolist()) for q in range(6)], "query_id long, query_vector array<double>")
    full = vectors.every_score(asked, corpus).collect()
    many = {i: n for i, _, n in rows}
    for k in (1, 7, 60, 10_000):
        want = {(r.query_id, r.id, r.score) for r in full if sum(many[o.id] for o in full if o.query_id == r.query_id and o.score > r.score) < k}
        assert {tuple(r) for r in vectors.nearest_until(asked, corpus, k).collect()} == want


def test_late_interaction_scans_and_probes_alike(spark):
    rng = np.random.default_rng(6)
    rows = [(d, rng.normal(0, 1, 6).astype(np.float32).tolist()) for d in range(120) for _ in range(1 + d % 5)] + [(3, [1.0]), (None, [0.5] * 6)]
    rows += [(200, [1.0] * 6)] * 700 + [(201, rows[0][1])] * 3
    index = LateIndex.build(spark.createDataFrame(rows, "doc_id long, vector array<float>").repartition(3), shared_path(spark, "test-late"), cells=8, sample=200)
    asked = spark.createDataFrame([(q, rng.normal(0, 1, 6).astype(np.float32).tolist()) for q in range(30) for _ in range(1 + q % 3)] + [(99, None)], "query_id long, vector array<float>")
    probed, scanned, chosen = (sorted(map(tuple, index.search(asked, 5, block=b, scan=s).collect())) for b, s in ((256, False), (256, True), (20, None)))
    assert probed == scanned == chosen and len(probed) == 150
    assert index.search(asked.limit(0), 5, scan=True).count() == 0


def test_targets_are_measured_together(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(0, 1, 4).tolist()) for i in range(200)] + [(300, None), (301, [1.0]), (302, [0.0] * 4)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(i, rows[i][1], rows[i + 1][1]) for i in range(0, 200, 20)] + [(7, rows[7][1], None), (8, rows[8][1], [1.0])], "query_id long, a array<double>, b array<double>")
    far = {k: vectors.every_score(asked.select("query_id", F.col(k).alias("query_vector")), corpus) for k in "ab"}
    want = {(r.query_id, r.id): [] for r in far["a"].join(far["b"], ["query_id", "id"]).collect()}
    for k in "ab":
        for r in far[k].collect():
            if (r.query_id, r.id) in want:
                want[r.query_id, r.id].append(round(1 - r.score, 9))
    for block in (1024, 3):
        found = vectors.target_distances(asked, corpus, ["a", "b"], block=block)
        assert not any(step in found._jdf.queryExecution().executedPlan().toString() for step in ("hashpartitioning", "Join", "Aggregate"))
        got = found.collect()
        assert {(r.query_id, r.id): [round(x, 9) for x in r.distances] for r in got} == want and len(got) == len(want)
        for r in got:
            own = [w for (q, _), w in want.items() if q == r.query_id]
            assert [round(x, 9) for x in r.low] == [min(w[i] for w in own) for i in (0, 1)] and [round(x, 9) for x in r.high] == [max(w[i] for w in own) for i in (0, 1)]


def test_scores_of_a_batch_are_held_in_parts(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["id"])
    parts = list(vectors._slices([batch], 1024))
    assert max(p.num_rows for p in parts) * 1024 <= vectors.HELD and sum(p.num_rows for p in parts) == 10_000


def test_samples_are_cut_before_they_are_sorted(spark):
    rows = spark.range(5000).select("id", F.array(F.col("id").cast("double")).alias("vector")).repartition(4)
    for table in (rows, rows.unionByName(rows), rows.limit(90), rows.withColumn("id", F.lit(7).cast("long")), rows.limit(0)):
        got = [r.id for r in vectors.lowest(table, F.xxhash64("id"), 100)]
        assert got == [r.id for r in table.orderBy(F.xxhash64("id"), "id").limit(100).collect()]
