"""Operators on hand-made cases."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import models, text
from larkspur.operators import cache, chunking, fusion, graph, heal, history, lexical, market, usage, vectors
from larkspur.plans import agent, relational, retrieval
from larkspur.sources import sinks

SUB = ("relevance", "specificity", "completeness", "practicality", "constraint_fit")


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())) if names else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("scores", "scale", "want"), [
    ((10,) * 5, 10, 1.0), ((0,) * 5, 10, 0.0), ((10, 0, 0, 0, 0), 10, 0.6), ((None,) * 5, 10, 0.0), ((5,) * 5, 10, 0.5),
    ((1, 0, 0, 0, 0), 3, 0.2), ((2, 0, 0, 0, 0), 3, 0.4), ((3, 0, 0, 0, 0), 3, 0.6), ((11, 0, 0, 0, 0), 10, None), ((-1, 0, 0, 0, 0), 10, None),
])
def test_weighted_score(spark, scores, scale, want):
    got = spark.createDataFrame([scores], ", ".join(f"{s} int" for s in SUB)).select(fusion.weighted_score(scale).alias("v")).first()["v"]
    assert got == want if want is None else abs(got - want) < 1e-9


def test_rerank_threshold_order_and_errors(spark):
    hits = spark.createDataFrame([(1, i, r, 5, 5, 5, 5) for i, r in ((1, 3), (2, 9), (3, 6))] + [(1, 4, None, None, None, None, None)], "query_id int, id int, " + ", ".join(f"{s} int" for s in SUB))
    out = fusion.reranked(hits, fusion.weighted_score(), 0.1).orderBy("rerank_rank").collect()
    assert [(r.id, r.rerank_rank) for r in out] == [(2, 1), (3, 2), (1, 3)]
    low = spark.createDataFrame([(1, 1, 2, 2, 2, 2, 2)], hits.schema)
    assert fusion.reranked(low, fusion.weighted_score(), 0.5).count() == 0
    failed = hits.select("query_id", "id").withColumn("s", F.lit(None).cast("double"))
    assert fusion.reranked(failed, F.col("s"), 0.1).count() == 0


def test_reciprocal_rank(spark):
    lists = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "a"), (1, 1, 2, "c")], "query_id int, list_id int, rank int, id string")
    got = fusion.reciprocal_rank(lists).orderBy("position").collect()
    assert [(r.id, r.score) for r in got] == [("a", round(2 / 60, 6)), ("b", round(1 / 61, 6)), ("c", round(1 / 61, 6))]
    assert fusion.reciprocal_rank(lists, rank_base=1).orderBy("position").first().score == round(2 / 61, 6)


def test_cosine_and_cache(spark):
    assert spark.sql("select array(0.0D, 0.0D) a, array(1.0D, 0.0D) b, array(1.0D) c").select(vectors.cosine(F.col("a"), F.col("b")).alias("z"), vectors.cosine(F.col("a"), F.col("c")).alias("n")).first().asDict() == {"z": 0.0, "n": None}
    requests = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.6, 0.8])], "request_id long, vector array<double>")
    entries = spark.createDataFrame([(1, [1.0, 0.0], "yes"), (2, [1.0, 0.0, 0.0], "other size"), (3, [0.0, 1.0], "")], "id long, vector array<double>, answer string")
    got = {r.request_id: r for r in cache.lookup(requests, entries, 0.8).collect()}
    assert (got[1].hit, got[1].answer) == (True, "yes") and (got[2].hit, got[2].best_score) == (False, 0.0)
    assert (got[3].hit, got[3].best_score, got[3].answer) == (False, 0.6, None)


def test_search_blocks_agree(spark):
    corpus = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "id long, vector array<double>")
    queries = corpus.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    a, b = (sorted((r.query_id, r.rank, r.id) for r in vectors.search(queries, corpus, 3, block=n).collect()) for n in (1000, 7))
    assert a == b and len(a) == 120 and vectors.search(queries.limit(0), corpus, 3).count() == 0


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, None), (4, "common")], "id long, text string")
    q = spark.createDataFrame([(1, "rare common"), (2, ""), (3, None)], "query_id long, query string")
    got = [(r.query_id, r.id) for r in lexical.search(docs, q).orderBy("query_id", "rank").collect()]
    assert got[0] == (1, 1) and {g[0] for g in got} == {1}


def diamond(spark):
    v = spark.createDataFrame([(c, i) for i, c in enumerate("abcdz")], "id string, pos long")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "src string, dst string")
    return v, e


def test_graph_walks(spark):
    v, e = diamond(spark)
    start = v.where("id = 'a'")
    assert sorted((r.id, r.depth) for r in graph.paths(e, start).collect()) == [("a", 0), ("b", 1), ("c", 1), ("c", 2), ("d", 2)]
    assert sorted((r.id, r.depth) for r in graph.reachable(e, start).collect()) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert {r.id: r.component for r in graph.components(v, e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "z": "z"}
    s = graph.stats(v, e).first()
    assert (s.n_nodes, s.n_edges, s.n_isolated, s.n_components, s.max_degree) == (5, 4, 1, 2, 3)
    assert graph.stats(v.limit(0), e.limit(0)).first().avg_degree == 0.0


def test_components_of_a_long_path(spark):
    v = spark.range(300).select(F.format_string("%04d", "id").alias("id"))
    e = spark.range(299).select(F.format_string("%04d", "id").alias("src"), F.format_string("%04d", F.col("id") + 1).alias("dst"))
    assert graph.components(v, e).select("component").distinct().count() == 1


def test_components_of_forests(spark, monkeypatch):
    rng = random.Random(7)
    pairs = [(f"{g}{rng.randint(0, 60):03d}", f"{g}{rng.randint(0, 60):03d}") for g in "abc" for _ in range(50 if g == "b" else 400)]
    pairs += [("hub", f"leaf{i}") for i in range(1200)] + [("a001", "nowhere"), ("nowhere", "b001"), (None, "a001"), ("a001", None)]
    known = {x for pair in pairs for x in pair} - {None, "nowhere"} | {"alone"}
    want = {x: x for x in known}
    while True:
        low = [(a, b, min(want[a], want[b])) for a, b in pairs if a in known and b in known]
        if all(want[a] == want[b] for a, b, _ in low):
            break
        for a, b, x in low:
            want[a] = want[b] = min(x, want[a], want[b])
    v, e = spark.createDataFrame([(x,) for x in [*known, "alone"]], "id string"), spark.createDataFrame(pairs, "src string, dst string").repartition(5)
    for folded, held in ((1 << 20, 1 << 18), (1, 3)):  # whole forests, and pieces of a few edges
        monkeypatch.setattr(graph, "FOLDED", folded)
        monkeypatch.setattr(graph, "FOREST", held)
        monkeypatch.setattr(graph, "SENT", 200_000 if folded > 1 else 10)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if folded > 1 else 50)
        try:
            assert sorted(map(tuple, graph.components(v, e).collect())) == sorted(want.items())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lines = spark.createDataFrame([(f"p{i % 40}", f"s{i % 3}") for i in range(9000)], "a string, b string").coalesce(2)
    monkeypatch.undo()
    assert graph.forest(lines).count() <= 2 * 42  # so few of the lines are shuffled


def test_load_integrity(spark):
    v = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, pos long")
    e = spark.createDataFrame([("a", "b", "2.5", "17", 1), ("a", "b", "9", "x", 2), ("b", "a", "bad", "1x", 3), ("a", "gone", "1", "1", 4)], "src string, dst string, weight string, created_at string, pos long")
    v2, e2 = graph.loaded(v, e)
    assert v2.count() == 2
    assert sorted((r.src, r.dst, r.weight, r.created_at) for r in e2.collect()) == [("a", "b", 2.5, 17), ("b", "a", 1.0, None)]


def test_healing(spark):
    v = spark.createDataFrame([("a", 1, "", "T", "A", [1.0, 0.0]), ("b", 2, "x", "T", "B", [1.0, 0.1]), ("c", 3, "long enough text", "T", "C", [1.0, 0.2]), ("d", 4, "short", None, "D", [0.0, 1.0])], "id string, num long, description string, type string, name string, vector array<double>").withColumn("pos", F.col("num"))
    e = spark.createDataFrame([("b", "b", 1.0)], "src string, dst string, weight double")
    assert {r.id for r in heal.prunable(v, e).collect()} == {"a", "d"}
    props = spark.createDataFrame([("c", "b", "r", 0.9), ("c", "nobody", "r", 0.9), ("b", "c", "r", None)], "source_id string, target_id string, relation string, confidence double")
    v2, e2, report = heal.healed(v, e, proposals=props)
    assert {r.id for r in v2.collect()} == {"b", "c"} and ("c", "b") in {(r.src, r.dst) for r in e2.collect()}
    assert [r.n_isolated for r in report.collect()][0] == 3 and report.collect()[-1].resolved_pct == 100.0
    assert heal.healed(v, e, dry_run=True)[1].count() == 1
    named = spark.createDataFrame([("c", " B ", 0.7, "r"), ("b", "b", 0.9, "r"), ("c", "d", 0.1, "r")], "source_id string, target_name string, confidence double, relation string")
    assert [(r.src, r.dst) for r in heal.relinked(v, named).collect()] == [("c", "b")]
    assert heal.proposal_prompts(v, e).first().prompt.startswith("Isolated:\na / A / T")


HELLO, M = "hello " * 10, 19  # 60 characters are 15 tokens, and 4 more


def pairs(spark, n):
    return spark.createDataFrame([(1, i, "Human" if i % 2 == 0 else "AI", HELLO) for i in range(2 * n)], "conv_id long, turn int, role string, text string")


@pytest.mark.parametrize(("n", "most", "keep", "kept", "triggered"), [(3, 8 * M, 4 * M, 6, False), (5, 8 * M, 4 * M, 4, True), (5, 8 * M, 3 * M + 1, 4, True), (5, 8 * M, M, 2, True), (1, 2 * M - 1, 2 * M + 100, 2, True)])
def test_history_split(spark, n, most, keep, kept, triggered):
    m = pairs(spark, n)
    assert history.over_budget(m, most).first().triggered is triggered
    got = [r for r in history.split(m, keep, most=most).orderBy("turn").collect() if r.kept]
    assert len(got) == kept and got[0].role == "human"


def test_history_summaries(spark):
    m = history.split(pairs(spark, 5), 4 * M)
    earlier = spark.createDataFrame([(1, "once")], "conv_id long, summary string")
    prompt = history.summary_prompts(m, earlier).first().prompt
    assert "once" in prompt and history.MERGE in prompt and "[사용자] hello" in prompt
    assert history.MERGE not in history.summary_prompts(m).first().prompt
    out = history.compacted(m, earlier).orderBy("turn").collect()
    assert out[0].role == "system" and history.PREVIOUS in out[0].text and len(out) == 5
    for new, want in (("", "old"), (None, "old"), ("new", "new")):
        assert spark.createDataFrame([("old", new)], "o string, n string").select(history.stored_summary(F.col("o"), F.col("n")).alias("v")).first().v == want
    assert history.measured(spark.createDataFrame([(1, 0, "AI", "")], "conv_id long, turn int, role string, text string")).first().n_tokens == 4


def test_dictionary(spark):
    texts = spark.createDataFrame([(1, "At the SEOUL Clinic, Aspirin was given"), (2, "nothing"), (3, None)], "id long, text string")
    names = spark.createDataFrame([("clinic", "Seoul Clinic"), ("drug", "aspirin"), ("drug", "")], "kind string, name string")
    assert sorted((r.id, r.kind, r.names) for r in history.detected(texts, names).collect()) == [(1, "clinic", ["Seoul Clinic"]), (1, "drug", ["aspirin"])]


@pytest.mark.parametrize(("given", "want"), [("2024-2-3", 20240203), ("2024-2", 20240201), ("2024", 20240101), ("2024-02-30", 0), ("None", 0), (None, 0), ("x", 0)])
def test_dates(spark, given, want):
    assert spark.createDataFrame([(given,)], "g string").select(text.date_key(F.col("g")).alias("v")).first().v == want


def test_windows_and_sections(spark):
    got = spark.createDataFrame([([str(i) for i in range(10)],), ([],)], "t array<string>").select(text.windows(F.col("t"), 4, 1).alias("w")).collect()
    assert [len(w) for w in got[0].w] == [4, 4, 4, 1] and [w[0] for w in got[0].w] == ["0", "3", "6", "9"] and got[1].w == []
    body = "## Head\n" + "x" * 72
    rows = spark.createDataFrame([(body + "\n## Short\n" + "y" * 10 + "\n## Z\n" + "z" * 90,)], "t string").select(text.markdown_sections(F.col("t")).alias("s")).first().s
    assert [(r.header, len(r.content)) for r in rows] == [("Head", 80), ("Z", 95)]


def test_even_cuts_and_packing(spark):
    assert chunking.even_cuts([3, 3, 3, 3], 6) == [(0, 2), (2, 4)] and chunking.even_cuts([], 5) == [] and chunking.even_cuts([1, 1], 5) == [(0, 2)]
    assert chunking.even_cuts([10], 3) == [(0, 1)]
    sections = spark.createDataFrame([(1, 0, 1, 1, "Title", 5, 1, True), (1, 1, 2, 2, "body", 5, 3, False), (1, 2, 2, 2, "more", 5, 3, False), (1, 3, 1, 1, "next", 1, 2, False)], "doc_id long, pos long, level int, last_level int, text string, n_tokens long, n_items int, is_header boolean")
    got = chunking.packed(sections, 12).orderBy("chunk_no").collect()
    assert [(r.text, r.n_tokens) for r in got] == [("Title\nbody", 10), ("more", 5), ("next", 1)]
    stack = spark.createDataFrame([(1, 0, 1, "A"), (1, 1, 2, "B"), (1, 2, None, "t"), (1, 3, 1, "C")], "doc_id long, pos long, level int, text string")
    assert [r.headings for r in chunking.heading_stack(stack).orderBy("pos").collect()] == [["A"], ["A", "B"], ["A", "B"], ["C"]]


def test_model_answers(spark):
    raw = ['```json\n[{"a": 1}]\n```', 'well [{"a": 2}] done', '{"a": [1]}', "[broken", None, "[]"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select("i", text.json_array(F.col("r"), "array<struct<a:int>>").alias("v")).orderBy("i").collect()
    assert [[x.a for x in r.v] for r in got] == [[1], [2], [], [], [], []]
    q = spark.createDataFrame([("q", '```json\n["a", "b", "c", "d"]\n```'), ("q", "no")], "q string, a string").select(agent.variants(F.col("q"), F.col("a")).alias("v"))
    assert [r.v for r in q.collect()] == [["q", "a", "b", "c"], ["q"]]
    v = spark.createDataFrame([('{"verdict": "Grounded"}',), ('```json\n{"verdict": "no"}\n```',), ("?",)], "a string").select(agent.verdict(F.col("a")).alias("v"))
    assert [r.v for r in v.collect()] == [True, False, True]
    assert [r.v for r in spark.createDataFrame([(" STOCK ",), ("x",), (None,)], "a string").select(agent.routed(F.col("a")).alias("v")).collect()] == ["stock", "rag", "rag"]


def test_plug_ins_may_fail(spark):
    def bad(*_):
        raise RuntimeError("down")

    rows = spark.createDataFrame([("a", "a b")], "q string, t string")
    assert rows.select(models.scored(F.col("q"), F.col("t"), bad).alias("v")).first().v is None
    assert rows.select(models.generated(F.col("q"), bad).alias("v")).first().v is None
    vector = rows.select(models.embedded(F.col("t")).alias("v")).first().v
    assert abs(sum(x * x for x in vector) - 1) < 1e-5


def test_agent_corrects_and_ends(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma", "s"), (2, "delta", "s")], "id long, text string, source string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "nothing known")], "request_id long, query string")
    done, stored = agent.answered(asked, docs, lambda prompts: ["zzz"] * len(prompts))
    got = {r.request_id: r for r in done.collect()}
    assert (got[1].corrections, got[1].grounded) == (2, False) and (got[2].corrections, got[2].grounded) == (0, True)
    assert stored.count() == 2


def test_percentiles_follow_places(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", 7.0)], "g string, v double")
    got = {r.g: (r.p50, r.p99) for r in usage.percentiles(rows, ["g"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    assert got == {"a": (50.0, 99.0), "b": (7.0, 7.0)}


def test_small_functions(spark):
    row = spark.createDataFrame([("n", None, "a\nb", "", "my_file_name.txt", 3.0)], "n string, d string, t string, e string, p string, s double")
    got = row.select(text.node_text(F.col("n"), F.col("d")).alias("a"), text.node_text(F.col("e"), F.col("e")).alias("b"), text.lines(F.col("t")).alias("c"), text.lines(F.col("e")).alias("d"), text.title_of(F.col("p")).alias("e"), text.score_bar(F.col("s"), 3).alias("f"), text.word_estimate(F.col("t")).alias("g")).first()
    assert tuple(got) == ("n", "unknown", 2, 0, "My File Name", "#" * 12, 2)
    assert market.checked(["a"], "1y") and market.checked(["a", "b"], "1d") is None and market.checked(["a", "b"], "3d") and market.checked(["a", "b"], "1y") is None
    assert spark.range(1).select(usage.winner(F.lit(8.0), F.lit(10.0)).alias("a"), usage.speed_up(F.lit(20.0), F.lit(10.0)).alias("b")).first().asDict() == {"a": "A", "b": "B 2.0x"}


def test_batch_round_trip(spark):
    lines = sinks.batch_requests(spark.createDataFrame([(3, "hi")], "i int, prompt string"), "m").first().value
    assert json.loads(lines)["custom_id"] == "chunk-3" and json.loads(lines)["body"]["messages"][0]["content"] == "hi"
    answers = [json.dumps({"custom_id": c, "response": {"body": {"choices": [{"message": {"content": " ok "}}]}}}) for c in ("chunk-3", "other-1")] + ["broken", ""]
    got = sinks.batch_results(spark.createDataFrame([(a,) for a in answers], "value string")).collect()
    assert [(r.i, r.content) for r in got] == [(3, "ok")]


def test_rescored_search_loses_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(700, 16)), 3)
    m[:5], m[5] = np.abs(m[:5]), 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (901, [1.0])], "vec_id long, embedding array<double>").withColumn("label", F.lit(0)).repartition(3)
    monkeypatch.setattr(retrieval.x, "t", lambda *_: rows)
    unit = m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)
    want = {}
    for q in range(0, 700, 50):
        scores = np.round(unit @ unit[q], 6)
        want[q] = [(int(i), float(scores[i]), int(((m[i] > 0) != (m[q] > 0)).sum())) for i in np.lexsort((np.arange(700), -scores))[:10]]
    got = {}
    for r in sorted(retrieval.bq_rescore(spark, "").collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.id, r.score, r.distance))
    assert {q: [(i, round(s, 5), d) for i, s, d in v] for q, v in got.items()} == {q: [(i, round(s, 5), d) for i, s, d in v] for q, v in want.items()}


def test_semantic_cache_holds_all_other_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 49 + 1), 1.0]) for i in range(101)], "vec_id long, embedding array<double>").withColumn("label", F.lit(0))
    monkeypatch.setattr(retrieval.x, "t", lambda *_: rows)
    got = {r.request_id: (r.best_score, r.hit, r.answer) for r in retrieval.cache_exact(spark, "").collect()}
    assert got == {0: (1.0, True, "a49"), 50: (1.0, True, "a1"), 100: (1.0, True, "a2")}


def test_heal_pipeline_runs_all_steps(spark, monkeypatch):
    # 20 and 16 to 19 have no edges: 20 says nothing, 16 is alike to 1 to 15, 17 to 19 are unlike them
    alike = {16: [0.0, 1.0]}
    rows = spark.createDataFrame([(i, alike.get(i, [0.0, -1.0]) if i > 15 else [0.0, 1.0], 3 if i > 15 else 1) for i in range(1, 21)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(relational.x, "t", lambda *_: rows)
    got = {r.step: (r.n_nodes, r.n_edges, r.n_isolated) for r in relational.heal_pipeline(spark, "").collect()}
    assert list(got) == ["start", "prune", "embed", "propose", "relink"]
    assert got["start"][0] == 20 and got["prune"][0] == 19 and got["prune"][2] == 4 and got["embed"][2] == 3
    # 16 to 18 propose the next vertex with 0.6 to 0.8, 19 the pruned 20; 16 and 17 find the one after that by name
    assert got["propose"] == (19, got["embed"][1] + 3, 0) and got["relink"] == (19, got["propose"][1] + 2, 0)
