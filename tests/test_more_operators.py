"""Operators against brute force and by hand: vectors by cells, chunking, batches, the agent, sinks."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur import shared
from larkspur.functions import models, text
from larkspur.operators import batches, cache, chunking, fusion, history, lexical, market, vectors
from larkspur.plans import agent
from larkspur.sources import files, sinks

# ---- vectors


@pytest.mark.parametrize(("least", "cells", "piece"), [(0.05, 8, 10_000), (0.6, 16, 40), (0.9, 1, 7)])
def test_similarity_join_loses_nothing(spark, least, cells, piece):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 12))
    m = centers[rng.integers(0, 6, 400)] + rng.normal(size=(400, 12)) * rng.choice([0.05, 0.5, 2.0], (400, 1))
    m[7], m[8] = 0, m[9]  # a zero vector and a tie
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (901, [1.0])], "id long, vector array<double>").repartition(3)
    asked = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = {(r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in vectors.similarity_join(asked, rows, 3, least, cells, piece, exclude_self=True).collect()}
    unit = m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)
    scores, want = np.round(unit @ unit.T, 9), {}
    for q in range(400):
        best = [i for i in np.lexsort((np.arange(400), -scores[q])) if i != q and scores[q, i] >= least][:3]
        want |= {(q, n + 1): (int(i), round(float(scores[q, i]), 9)) for n, i in enumerate(best)}
    assert got.keys() == want.keys() and all(got[k][0] == v[0] and abs(got[k][1] - v[1]) < 1e-8 for k, v in want.items())
    assert vectors.similarity_join(asked.limit(0), rows, 3, least).collect() == [] == vectors.similarity_join(asked, rows.limit(0), 3, least).collect()


def test_vectors_of_different_lengths_meet_only_their_own(spark):
    rng = np.random.default_rng(9)
    sizes = rng.choice([0, 2, 3, 5], 150, p=[0.1, 0.6, 0.2, 0.1])
    m = [rng.normal(size=n) for n in sizes]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(900, None)], "id long, vector array<double>").repartition(3)
    asked = rows.unionByName(spark.createDataFrame([(901, [1.0] * 9)], "id long, vector array<double>")).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))

    def best(least, self_too, k=4):
        out = {}
        for q, v in enumerate(m):
            scores = [(-round(float(v @ w / np.sqrt((v @ v) * (w @ w))) if len(v) else 0.0, 9), i) for i, w in enumerate(m) if len(w) == len(v) and (self_too or i != q)]
            out |= {(q, n + 1): i for n, (s, i) in enumerate(sorted((s, i) for s, i in scores if -s >= least)[:k])}
        return out

    got = {(r.query_id, r["rank"]): r.id for r in vectors.similarity_join(asked, rows, 4, 0.3, 6, 20, exclude_self=True).collect()}
    assert got == best(0.3, False)
    for block in (1000, 7):
        assert {(r.query_id, r["rank"]): r.id for r in vectors.search(asked, rows, 4, block=block).collect()} == best(-2, True)


def test_search_keeps_the_best_over_batches(spark):
    rng = np.random.default_rng(6)
    m = np.round(rng.normal(size=(3000, 4)), 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "170")
    try:
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>").coalesce(1)
        got = {}
        for r in vectors.search(rows.where("id < 5").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), rows, 9, exclude_self=True).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    for q in range(5):
        scores = np.round(unit @ unit[q], 9)
        assert got[q] == [int(i) for i in np.lexsort((np.arange(3000), -scores)) if i != q][:9]


def test_pooling_and_relative_targets(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0]), (3, None)], "id long, vector array<double>")
    got = {r.id: [round(x, 6) for x in r.vector] for r in vectors.mean_pooled(rows).collect()}
    assert got == {1: [0.707107, 0.707107], 2: [0.0, 0.0]}
    d = spark.createDataFrame([(1, 0.0, 5.0), (2, 1.0, 5.0), (3, 0.5, 5.0)], "id long, a double, b double")
    assert {r.id: r.relative for r in vectors.relative_targets(d, {"a": 0.7, "b": 0.3}).collect()} == {1: 0.0, 2: 0.7, 3: 0.35}


def test_frequent_keys_are_looked_up_alike(spark):
    rows = spark.createDataFrame([(n, 0 if n % 3 else n % 7) for n in range(600)] + [(601, None), (602, 99)], "n long, k long")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(7)], "k long, v string")
    want = sorted((r.k, r.n, r.v) for r in rows.join(table, "k").collect())
    for most, least in ((10_000, 500), (4, 0), (600, 0)):
        assert sorted((r.k, r.n, r.v) for r in shared.looked_up(rows, table, "k", most, least).collect()) == want


# ---- lexical


def test_an_index_answers_for_its_terms(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma"), (3, None), (4, "beta gamma delta")], "id long, text string")
    asked = spark.createDataFrame([(1, "Beta delta"), (2, "nothing")], "query_id long, query string")
    held = lexical.index(docs, asked)
    assert held.answers(asked.limit(1)) and not held.answers(spark.createDataFrame([(9, "gamma")], "query_id long, query string"))
    one, two, three = (sorted((r.query_id, r.id, round(r.score, 9)) for r in lexical.scores(d, asked).collect()) for d in (held, docs, lexical.index(docs, asked.union(asked.limit(1)))))
    assert one == two == three and {d for _, d, _ in one} == {1, 4}


# ---- chunking


def test_kept_together_follows_parents_to_the_last(spark):
    items = spark.createDataFrame([(1, n, f"i{n}") for n in range(40)] + [(2, 0, "other")], "doc_id long, pos long, id string")
    chain = [(f"i{n}", f"i{n - 1}") for n in range(4, 20)] + [("i25", "i26"), ("i26", "i27"), ("i27", "i25"), ("i28", "i25"), ("i30", "nowhere"), ("i31", "other"), ("i32", None), ("i33", "i35"), ("i33", "i34")]
    got = {r.pos: r.group_pos for r in chunking.kept_together(items, spark.createDataFrame(chain, "id string, parent_id string")).where("doc_id = 1").collect()}
    assert got == {n: 3 if 4 <= n < 20 else 34 if n == 33 else n for n in range(40)}
    none = spark.createDataFrame([], "id string, parent_id string")
    assert all(r.pos == r.group_pos for r in chunking.kept_together(items, none).collect())


def naive_cuts(counts, most):
    total, n = sum(counts), len(counts)
    if total <= most:
        return [(0, n)] if n else []
    sums = [sum(counts[:i]) for i in range(n + 1)]
    parts, cuts = -(-total // most), [0]
    for t in range(1, parts):
        goal = t * total / parts
        free = range(cuts[-1] + 1, n)
        if free:  # the nearest that is left; from above before from below
            cuts.append(min(free, key=lambda j: (abs(sums[j] - goal), sums[j] < goal, j if sums[j] >= goal else -j)))
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def test_even_cuts_equal_the_search_for_the_nearest():
    rng = random.Random(4)
    for _ in range(3000):
        counts = [rng.choice([0, 1, 2, 5, 9, 30, 80]) for _ in range(rng.randint(0, 12))]
        most = rng.randint(1, 60)
        assert chunking.even_cuts(counts, most) == naive_cuts(counts, most), (counts, most)


def test_packing_against_a_walk(spark):
    rng, rows = random.Random(8), []
    for doc in range(40):
        rows += [(doc, pos, rng.choice([-1, 0, 1, 2]), rng.choice([0, 1, 2]), rng.choice(["h", "x" * 40]), rng.randint(1, 30), rng.choice([1, 1, 2]), rng.random() < 0.4) for pos in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "doc_id long, pos long, level int, last_level int, text string, n_tokens long, n_items int, is_header boolean")
    got = {}
    for r in chunking.packed(df, 40).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append((r.first_pos, r.n_sections, r.n_tokens))
    for doc in range(40):
        own = [r for r in rows if r[0] == doc]
        # whether a section is joined to the one after it, from the last backwards
        joined = [False] * len(own)
        for i in range(len(own) - 2, -1, -1):
            _, _, _, last, t, _, items, header = own[i]
            lone = header and items == 1 and len(t) <= 30
            joined[i] = lone and not 0 <= own[i + 1][2] < last
        groups, at = [], 0
        while at < len(own):
            end = at
            while joined[end]:
                end += 1
            groups.append((own[at][1], end - at + 1, sum(r[5] for r in own[at : end + 1]), own[at][2], own[end][3]))
            at = end + 1
        chunks = []
        for first, n, tokens, level, last in groups:
            if chunks and chunks[-1][2] + tokens <= 40 and not 0 <= level < chunks[-1][3]:
                chunks[-1] = (chunks[-1][0], chunks[-1][1] + n, chunks[-1][2] + tokens, last)
            else:
                chunks.append((first, n, tokens, last))
        assert got[doc] == [c[:3] for c in chunks]


def test_pieces_of_lines_and_sentences(spark):
    rng = random.Random(2)
    texts = ["\n".join(" ".join(rng.choices(["ab", "cde.", "f", "ghij!"], k=rng.randint(0, 30))) for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["", None, "word " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", text.packed_lines(F.col("t"), 60).alias("p"), text.piecewise_tokens(F.col("t"), 60).alias("n"), text.split_pieces(F.col("t"), 7).alias("s")).collect():
        pieces = []
        for line in (r.t or "").split("\n"):
            if pieces and len(pieces[-1]) + len(line) + 1 <= 60:
                pieces[-1] += "\n" + line
            else:
                pieces.append(line)
        assert r.p == pieces and r.n == sum(int(len(p.split()) * 1.3) for p in pieces)
        assert [w for p in r.s or [] for w in p.split()] == (r.t or "").split()
        assert all(len(p.split()) <= 7 for p in r.s or []) and all(len(a.split()) + len(b.split()) > 7 or a[-1] not in " " for a, b in zip(r.s or [], (r.s or [])[1:], strict=False))


def test_tables_media_boxes_and_numbers(spark):
    html = "<table><tr><th>A</th><td>b <b>c</b></td></tr><tr><td></td><td>d</td></tr></table>"
    row = spark.createDataFrame([(html, "| A | b |\n|---|:--:|\n| c |  |", [("r1", "x/y/z.png"), ("r2", None)], 0.1234, "n")], "h string, m string, p array<struct<ref:string,image:string>>, s double, n string")
    boxes = F.array(F.struct(F.lit("text").alias("label"), F.lit("#/1").alias("ref"), *[F.lit(v).alias(k) for k, v in (("l", 10.0), ("t", 20.0), ("r", 50.0), ("b", 100.0))]))
    got = row.select(text.table_text(F.col("h")), text.table_text(F.col("m")), text.media_list(F.col("p")), text.bbox_json(boxes, F.lit(100.0), F.lit(200.0)), text.percent(F.col("s")), text.percent(F.lit(None)), text.rounded(F.lit("3.14159")), text.rounded(F.col("n"))).first()
    assert list(got)[:2] == ["A b c d", "A b c"] and json.loads(got[2]) == [{"ref": "r1", "name": "z.png"}]
    assert json.loads(got[3]) == [{"label": "text", "ref": "#/1", "l": 0.1, "t": 0.1, "r": 0.5, "b": 0.5}]
    assert list(got)[4:] == ["12.34%", "-", "3.14", "N/A"]


def test_context_lines_by_hand(spark):
    rows = [(1, 1, ["A"], "x"), (1, 2, ["A", "B"], "y"), (1, 3, ["A", "B"], "z"), (1, 4, ["A", "C", "D"], "w"), (1, 5, ["A", "C", "E"], "v"), (1, 6, ["Z"], "u"), (1, 7, None, "t")]
    got = chunking.context_lines(spark.createDataFrame(rows, "doc_id long, pos long, headings array<string>, text string"))
    assert [r.context for r in got.orderBy("pos").collect()] == ["", "A, ", None, None, "A, C, ", None, None]


def test_a_document_without_chunks_ends_the_job(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    items = spark.createDataFrame([(1, 1, "a")], "doc_id long, page int, text string")
    made = chunking.chunked(docs, items, lambda rows: [(r[0], r[2]) for r in rows], "doc_id long, text string")
    assert sorted(tuple(r) for r in made.collect()) == [(1, "a"), (2, ".")]
    with pytest.raises(Exception, match="no chunk was made of document"):
        chunking.chunked(docs, items, lambda rows: [], "doc_id long, text string").collect()


# ---- history


def test_names_within_words(spark):
    texts = spark.createDataFrame([(1, "아세리스는 좋다. RELIC-9 plus"), (2, "아세리 스"), (3, None), (4, "x" * 3000 + "lyrica" + "y" * 3000), (5, "(C++) **")], "id long, text string")
    names = spark.createDataFrame([("p", n) for n in ("아세리스", "Lyrica", "relic-9", "C++", "**", "", "plus two")], "kind string, name string")
    got = {r.id: r.names for r in history.detected(texts, names).collect()}
    assert got == {1: ["relic-9", "아세리스"], 4: ["Lyrica"], 5: ["**", "C++"]}
    only = spark.createDataFrame([("q", "좋다")], "kind string, name string")
    assert [(r.id, r.kind) for r in history.detected(texts, names, only).collect()] == [(1, "q")]


def test_request_context_and_rewriting(spark):
    messages = spark.createDataFrame([(1, 1, "user", "hello lyrica"), (1, 2, "assistant", "hi")], "conv_id long, turn int, role string, text string")
    asked = spark.createDataFrame([(1, "what of lyrica at Dr. Kim"), (2, "alone")], "conv_id long, question string")
    known = {k: spark.createDataFrame([(n,) for n in names], "name string") for k, names in (("company_products", ["Lyrica"]), ("competitive_products", ["Other"]), ("hospitals", ["dr. kim"]))}
    got = {r.conv_id: r.context.asDict() for r in history.request_context(messages, asked, known).collect()}
    assert set(got[1]) == set(history.CONTEXT) and len(got[1]) == 8
    assert got[1]["detected_company_products"] == ["Lyrica"] and got[1]["detected_hospitals"] == ["dr. kim"] and got[2]["detected_hospitals"] == []
    assert got[1]["known_products"] == "Lyrica,Other" and len(got[1]["all_messages"]) == 2

    dialogue = messages.groupBy("conv_id").agg(F.max("text").alias("text"))

    def asked_with(model):
        return {r.conv_id: r.rewritten for r in history.rewritten_questions(asked, dialogue, model).collect()}

    def broken(_):
        raise OSError

    same = {1: "what of lyrica at Dr. Kim", 2: "alone"}
    assert asked_with(None) == asked_with(broken) == asked_with(lambda p: [" "] * len(p)) == same
    assert asked_with(lambda p: ["new"] * len(p)) == {1: "new", 2: "alone"}


# ---- batches, agent, market


def test_batches_are_resumed(spark, tmp_path):
    path = str(tmp_path / "batch")
    batches.submitted(spark.createDataFrame([(1, "a"), (2, "b")], "i int, prompt string"), path, "m")
    assert spark.read.text(f"{path}/requests").count() == 2
    said = iter(["validating", "in_progress", "completed"])
    assert batches.polled("x", lambda _: next(said), 5) == "collect" and batches.polled("x", lambda _: "queued", 2) == "wait"
    assert [batches.state(s) for s in ("failed", "expired", "cancelled", "completed", "new")] == ["give up"] * 3 + ["collect", "wait"]
    lines = [json.dumps({"custom_id": c, "response": {"body": {"choices": [{"message": {"content": "ok"}}]}}}) for c in ("chunk-2", "chunk-9")]
    got = batches.resumed(path, spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.response for r in got.collect()] == ["ok"] and got.count() == 1
    hits, left = cache.answered(spark.createDataFrame([("a",), ("b",)], "prompt string"), got)
    assert [r.prompt for r in hits.collect()] == ["b"] and [r.prompt for r in left.collect()] == ["a"]


def test_fan_out_equals_one_by_one(spark):
    tools = {"double": lambda d: d.select("i", (F.col("i") * 2).alias("x")), "text": lambda d: d.select("i", F.col("i").cast("string").alias("t"))}
    rows = spark.range(5).select(F.col("id").alias("i"))
    got = batches.fanned_out(rows, tools)
    for name, tool in tools.items():
        own = tool(rows)
        assert sorted(map(tuple, got.where(F.col("tool") == name).select(*own.columns).collect())) == sorted(map(tuple, own.collect()))


def prices(spark):
    rows = [("ABC", f"2024-01-0{d}", float(10 * d)) for d in range(1, 6)] + [("XYZ", f"2024-01-0{d}", 5.0) for d in range(1, 6)]
    return spark.createDataFrame(rows, "ticker string, day string, close double").select("ticker", F.to_timestamp("day").alias("ts"), F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), "close", F.lit(1).cast("long").alias("volume"))


def test_agent_routes_caches_and_corrects(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma", "s"), (2, "delta epsilon", "t")], "id long, text string, source string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "Stock price of abc and XYZ"), (3, "stock of nobody"), (4, "nothing known"), (5, "kept question")], "request_id long, query string")
    known = spark.createDataFrame([(9, "kept question", "the answer")], "id long, query string, answer string").select("id", models.embedded(F.col("query")).alias("vector"), "answer")
    done, stored = agent.answered(asked, docs, cached=known, prices=prices(spark))
    got = {r.request_id: r for r in done.collect()}
    assert (got[5].route, got[5].answer) == ("cache", "the answer")
    assert got[2].answer == "ABC: 50.00 (+25.00%), return 400.00%\nXYZ: 5.00 (+0.00%), return 0.00%" and got[3].answer == agent.NO_STOCK and got[3].route == "stock"
    assert got[1].answer == "[1] s\nalpha beta gamma" and got[4].answer == fusion.EMPTY_CONTEXT and got[1].grounded
    assert sorted(r.query for r in stored.collect()) == sorted(r.query for r in asked.where("request_id <> 5").collect())
    again, _ = agent.answered(asked.where("request_id = 1"), docs, cached=stored, threshold=0.999)
    assert again.first().route == "cache" and again.first().answer.endswith("gamma\n\n(corrections: 0)")

    def no(prompts):
        return ['{"verdict": "not grounded"}'] * len(prompts)

    done, _ = agent.answered(asked.where("request_id = 1"), docs, checker=no, corrector=lambda q: ["delta"] * len(q))
    assert (done.first().answer, done.first().corrections, done.first().grounded) == ("[1] t\ndelta epsilon", 2, False)
    done, _ = agent.answered(asked.where("request_id in (1, 2)"), docs, router=lambda q: ["RAG "] * len(q), checker=lambda p: ["?"] * len(p))
    assert {r.route for r in done.collect()} == {"rag"} and all(r.grounded for r in done.collect())


def test_price_periods(spark):
    assert market.history(prices(spark), "1d").count() == 2 and market.history(prices(spark), "5y").count() == 10
    with pytest.raises(ValueError, match="unknown period"):
        market.history(prices(spark), "2d")


def test_context_with_sources_and_scores(spark):
    hits = spark.createDataFrame([(1, 1, "f.md", "intro", 0.01639, "text a"), (1, 2, "g.md", "end", 0.0161, "text b")], "query_id long, rank int, source string, section string, score double, content string")
    got = fusion.context(hits, ["query_id"], ["rank"], style="scored").first().context
    assert got == "[출처: f.md / intro | RRF: 0.0164]\ntext a\n\n---\n\n[출처: g.md / end | RRF: 0.0161]\ntext b"


# ---- sources and sinks


def test_parsers_take_turns(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-good"), ("b.pdf", b"%PDF-noise"), ("c.bin", b"\xff\xfe")):
        (tmp_path / name).write_bytes(content)

    def first(raw):
        if b"good" not in raw:
            raise ValueError("first")
        return "good"

    def second(raw):
        return raw.decode("ascii").replace("%PDF-noise", "GLYPH<1> GLYPH<2>")

    got = {r.path.rsplit("/", 1)[1]: (r.text, r.parser, r.error) for r in files.parsed_documents(spark, str(tmp_path), first, second, ocr=lambda raw: "read again").collect()}
    assert got["a.pdf"] == ("good", 0, None) and got["b.pdf"] == ("read again", -1, None)
    assert got["c.bin"][:2] == (None, None) and got["c.bin"][2].startswith("first; ")


def test_more_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i:02d}", float(i)) for i in range(37)], "k string, v double").repartition(5)
    got = {r.k: r._id for r in sinks.indexed_docs(rows, ["k"]).collect()}
    assert got == {f"k{i:02d}": i + 1 for i in range(37)}
    dealt = sinks.in_batches(rows, "k", 10)
    assert dealt.select("batch_no").distinct().count() <= 4 and dealt.count() == 37
    lines = sinks.vector_lines(spark.createDataFrame([(1, [1.0, 2.0], None)], "id int, vector array<double>, t string"))
    assert json.loads(lines.first().value) == {"id": 1, "vector": [1.0, 2.0], "t": None}
    report = sinks.markdown_table(spark.createDataFrame([("a|b", 1), ("c", None)], "name string, n int"), ["name"])
    assert [r.value for r in report.orderBy("pos").collect()] == ["| name | n |", "|---|---|", "| a\\|b | 1 |", "| c |  |"]
    assert sinks.versioned(rows, str(tmp_path / "v"), "1", n_changes=0) is None and sinks.versioned(rows, str(tmp_path / "v"), "1", dry_run=True) is None
    assert sinks.versioned(rows, str(tmp_path / "v"), "1", n_changes=2).endswith("version=1") and files.object_count(spark.read.parquet(str(tmp_path / "v/version=1"))) == 37
    sinks.create(rows, str(tmp_path / "t"), keys=["k"])
    assert spark.read.parquet(str(tmp_path / "t")).where("k = 'k07'").first().v == 7.0


def test_scratch_tables_are_removed(spark):
    with shared.scratch(spark):
        first = len(shared._GIVEN)
        assert shared.materialise(spark.range(4), "u").count() == 4
        (path,) = (p.removeprefix("file:") for p in shared._GIVEN[first:])
        assert os.path.isdir(path)
    assert not os.path.exists(path) and len(shared._GIVEN) == first


def test_a_search_shuffles_the_best_of_each_task_only(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(1, 30))))) for i in range(300)] + [(i, "w1 w2 w3") for i in range(300, 340)]
    odd = [(5, "w1 w7"), (5, "w9 w9"), (5, "w1"), (None, "w3 w4"), (None, "w4 w4"), (1000, None), (1001, "")]
    asked = spark.createDataFrame([(i, " ".join(rng.choice(words, 5))) for i in range(20)] + [(3, "w1 w8"), (None, "w2"), (77, None), (78, "nowhere")], "query_id long, query string")
    for rows in (docs, docs + odd, []):
        table = spark.createDataFrame(rows, "id long, text string").repartition(3)
        want = sorted(map(str, lexical.ranked(lexical.scores(table, asked), 4).select("query_id", "id", F.round("score", 6), "rank").collect()))
        for block in (1 << 17, 7):
            monkeypatch.setattr(lexical, "BLOCK", block)
            assert sorted(map(str, lexical.search(table, asked, 4).select("query_id", "id", F.round("score", 6), "rank").collect())) == want
    found = lexical.best_hits(spark.createDataFrame(docs, "id long, text string").coalesce(2), asked, 4).groupBy("query_id").count()
    assert max(r["count"] for r in found.collect()) <= 4 * spark.sparkContext.defaultParallelism
    named = spark.createDataFrame([(f"d{i}", t) for i, t in docs], "id string, text string")
    assert lexical.search(named, asked, 4).count() == 84


def test_a_full_page_is_dealt_to_pieces(spark):
    shape = "doc_id long, page int, id long, l double, t double, r double, b double"
    p = [(1, 1, i, float(i % 3), 0.0, float(i % 3 + i % 4), 2.0) for i in range(60)] + [(2, None, 70, 0.0, 0.0, 1.0, 1.0), (3, 1, 71, 0.0, 0.0, 1.0, 1.0)]
    t = [(1, 1, 100 + i, float(i % 2), 0.0, float(i % 2 + 2), 3.0) for i in range(9)] + [(2, None, 200, 0.0, 0.0, 1.0, 1.0), (4, 1, 201, 0.0, 0.0, 1.0, 1.0)]
    pictures, tables = spark.createDataFrame(p, shape), spark.createDataFrame(t, shape)
    whole, dealt = (sorted(map(tuple, chunking.pictures_in_tables(pictures, tables, piece=n).collect())) for n in (500, 7))
    want = [(a[0], a[2], c[2]) for a in p for c in t if a[0] == c[0] and a[1] == c[1] is not None and a[5] > a[3] and max(min(a[5], c[5]) - max(a[3], c[3]), 0) * max(min(a[6], c[6]) - max(a[4], c[4]), 0) > 0.5 * (a[5] - a[3]) * (a[6] - a[4])]
    assert whole == dealt and [w[:3] for w in whole] == sorted(want) and want
