"""Passages, budgets and measures against plain Python."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from larkspur.operators import evaluation, passages

MARKS = [". ", "! ", "? ", "\n", "... ", " ", " "]


def texts(rng, n):
    words = ["alpha", "beta", "gamma", "delta", "Eps", "zeta", "eta", "#x", "é"]
    made = ["".join(rng.choice(words) + rng.choice(MARKS) for _ in range(rng.randint(0, 90))) for _ in range(n)]
    return [None, "", "...", "one", "one. ", "# a\n# b\nc", *made]


def sentences(text):
    return [s for s in (x.strip(" ") for x in re.findall(r"[^.!?\n]+[.!?]*", text or "")) if re.search(r"[^\W_]", s)]


def words(text):
    return list(dict.fromkeys(w for w in re.split(r"[\W_]+", text.lower()) if w))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in enumerate(rows)], "doc_id long, text string, chunk string, limit int, cuts double").repartition(3)


def test_chunks_are_those_of_a_plain_walk(spark):
    rows = texts(random.Random(1), 120)
    for share in (0.9, 0.5, 0.0, 1.0):
        want = []
        for i, text in enumerate(rows):
            ss = sentences(text)
            far = []
            for a, b in zip(ss, ss[1:]):
                a, b = set(words(a)), set(words(b))
                far.append(1 - (len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0))
            o, at = sorted(far), (len(far) - 1) * share
            cut = o[math.floor(at)] + (at - math.floor(at)) * (o[math.ceil(at)] - o[math.floor(at)]) if o else 0
            chunks = [[ss[0]]] if ss else []
            for s, d in zip(ss[1:], far):
                chunks.append([s]) if d > cut else chunks[-1].append(s)
            want += [(i, n, len(c), " ".join(c)) for n, c in enumerate(chunks)]
        assert sorted(map(tuple, passages.semantic_chunks(frame(spark, rows), share).collect())) == want
    assert passages.semantic_chunks(frame(spark, rows).limit(0)).collect() == []


def test_chunks_of_a_long_text_take_no_quadratic_time(spark):
    ends = [f"w{i % 7} w{i % 3} w{i % 11}." for i in range(6000)]
    began = time.monotonic()
    got = passages.semantic_chunks(frame(spark, [" ".join(ends), "...\n?", None])).collect()
    assert sum(r.n_sentences for r in got) == 6000 and {r.doc_id for r in got} == {0}
    assert time.monotonic() - began < 45  # a limit that is worked out for each distance takes minutes


def test_chunks_by_vectors(spark):
    docs = spark.createDataFrame([(1, "a. b. c. d.", [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.1, 1.0]])], "doc_id long, text string, vectors array<array<double>>")
    from larkspur.operators.vectors import cosine

    got = passages.semantic_chunks(docs, 0.5, cosine, F.col("vectors")).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.chunk_no)] == ["a. b.", "c. d."]


def test_trees_and_roll_up(spark):
    rows, rng = texts(random.Random(2), 60), random.Random(3)
    got = {}
    for r in passages.tree(frame(spark, rows), per_section=2).collect():
        got.setdefault(r.doc_id, []).append((r.sentence, r.section, r.paragraph, r.text))
    trees = {}
    for i, text in enumerate(rows):
        section, within, number, own = -1, 0, 0, []
        for p, line in enumerate(x for x in (text or "").split("\n") if sentences(x)):
            if line.lstrip(" ").startswith("#"):
                within = 0
            if within % 2 == 0:
                section += 1
            within += 1
            for s in sentences(line):
                own.append((number, section, p, s))
                number += 1
        if own:
            trees[i] = own
    assert {i: sorted(v) for i, v in got.items()} == trees

    hits = {(q, i, n) for q in range(4) for i, own in trees.items() for n, *_ in own if rng.random() < 0.15 * (q + 1)}
    want = set()
    for q in range(4):
        for i, own in trees.items():
            live = {("sentence", n, n) for n, *_ in own if (q, i, n) in hits}
            kids, below = {(n, n) for n, *_ in own}, "sentence"
            for level, key in (("paragraph", lambda r: r[2]), ("section", lambda r: r[1]), ("document", lambda r: 0)):
                spans = {}
                for r in own:
                    a, b = spans.get(key(r), (r[0], r[0]))
                    spans[key(r)] = min(a, r[0]), max(b, r[0])
                for a, b in spans.values():
                    inside = [k for k in kids if a <= k[0] and k[1] <= b]
                    if sum((below, *k) in live for k in inside) >= 0.6 * len(inside):
                        live = {x for x in live if not (a <= x[1] and x[2] <= b)} | {(level, a, b)}
                kids, below = set(spans.values()), level
            want |= {(q, i, *x) for x in live}
    asked = spark.createDataFrame(sorted(hits), "query_id long, doc_id long, sentence int")
    found = [tuple(r) for r in passages.rolled_up(passages.tree(frame(spark, rows), per_section=2), asked.unionAll(asked), 0.6).collect()]
    assert len(found) == len(set(found)) and set(found) == want and len({x[2] for x in want}) == 4


def test_compression_is_plain_greedy(spark):
    rng, rows = random.Random(4), []
    for q in range(30):
        for d in range(3):
            rows += [(q, d, s, d + 1, rng.sample("abcdefgh", rng.randint(0, 4)), rng.randint(1, 9)) for s in range(rng.randint(0, 12))]
    got = {}
    for r in passages.compressed(spark.createDataFrame(rows, "query_id long, doc_id long, sentence int, rank int, terms array<string>, cost int").repartition(4), 15).collect():
        got.setdefault(r.query_id, []).append((r.step, r.doc_id, r.sentence, r.gain, r.cost))
    for q in range(30):
        left, covered, out, own = 15, set(), [], [r for r in rows if r[0] == q]
        while True:
            fits = [(-len(set(t) - covered), rank, s, d, c, t) for _, d, s, rank, t, c in own if c <= left and set(t) - covered]
            if not fits:
                break
            gain, _, s, d, c, t = min(fits, key=lambda x: x[:4])
            covered, left = covered | set(t), left - c
            out.append((len(out) + 1, d, s, -gain, c))
        assert sorted(got.get(q, [])) == out and sum(x[4] for x in out) <= 15


def test_budgets(spark):
    rng = random.Random(5)
    rows = [(q, p, n, rng.randint(1, 40)) for q in range(40) for p in ("a", "b", "c", "other") for n in range(rng.randint(0, 6))]
    shares = {"a": 0.25, "b": 0.25, "c": 0.5}
    got = {tuple(r) for r in passages.budgeted(spark.createDataFrame(rows, "query_id long, part string, rank int, cost int"), 100, shares).select("query_id", "part", "rank", "cost").collect()}
    want = set()
    for q in range(40):
        need = {p: sum(r[3] for r in rows if r[:2] == (q, p)) for p in shares}
        allowed = {p: min(need[p], int(100 * s)) for p, s in shares.items()}
        spare = 100 - sum(allowed.values())
        for p in shares:
            more = min(need[p] - allowed[p], spare)
            allowed[p], spare = allowed[p] + more, spare - more
        for p in shares:
            used = 0
            for r in sorted(r for r in rows if r[:2] == (q, p)):
                used += r[3]
                if used <= allowed[p]:
                    want.add(r)
    assert {(q, p, n, c) for q, p, n, c in got} == want


def test_ranking_measures(spark):
    rng, k = random.Random(6), 5
    lists = [(q, x, n + 1, i) for q in range(20) for x in "ab" for n, i in enumerate(rng.sample(range(12), rng.randint(1, 8)))]
    lists.append((50, "a", 1, 3))  # nothing judged
    judged = {(q, i): rng.choice([0, 0, 1, 2, 3]) for q in range(20) for i in range(12) if rng.random() < 0.6}
    got = {(r.query_id, r.list_id): r for r in evaluation.ranking(spark.createDataFrame(lists, "query_id long, list_id string, rank int, id long"), spark.createDataFrame([(*a, g) for a, g in judged.items()], "query_id long, id long, grade int"), k).collect()}
    assert len(got) == len({r[:2] for r in lists})
    for (q, x), r in got.items():
        own = [judged.get((q, i), 0) for _, _, n, i in sorted(y for y in lists if y[:2] == (q, x)) if n <= k]
        best = sorted((g for (a, _), g in judged.items() if a == q), reverse=True)
        dcg = lambda gs: sum((2**g - 1) / math.log2(n + 1) for n, g in enumerate(gs, 1))
        at = [n for n, g in enumerate(own, 1) if g >= 1]
        all_good = sum(g >= 1 for g in best)
        assert r.ndcg == pytest.approx(dcg(own) / dcg(best[:k]) if dcg(best[:k]) else 0)
        assert r.mrr == (1 / at[0] if at else 0) and r.recall == (len(at) / all_good if all_good else 0)
        assert r.precision == pytest.approx(sum((j + 1) / n for j, n in enumerate(at)) / len(at) if at else 0)


def test_faithfulness(spark):
    answers = spark.createDataFrame([(1, "The cat sat. The dog ran far."), (2, "..."), (3, "alone here"), (4, None)], "query_id long, answer string")
    contexts = spark.createDataFrame([(1, "a cat sat on the mat"), (1, "dog ran"), (3, None)], "query_id long, text string")
    got = {r.query_id: (r.n_claims, r.n_supported, r.faithfulness) for r in evaluation.faithfulness(answers, contexts).collect()}
    assert got == {1: (2, 1, 0.5), 3: (1, 0, 0.0)}


def test_waves_are_those_of_a_plain_interpreter(spark):
    from larkspur.operators import waves

    rng, rows = random.Random(7), []
    for q in range(40):
        n = rng.randint(1, 7)
        for s in range(1, n + 1):
            needs = rng.sample([x for x in range(1, n + 2) if x != s or q % 7 == 0], rng.choice([0, 0, 1, 1, 2]) if n > 1 else 0)
            rows.append((q, s, f"q{q}.{s}(" + ",".join(f"{{{x}}}" for x in needs) + ")", needs or None if rng.random() < 0.5 else needs))
    want = {}
    for q in range(40):
        own = {s: (t, n or []) for a, s, t, n in rows if a == q}
        answers, wave = {}, {}
        go = True
        while go:
            ready = [s for s, (_, n) in own.items() if s not in wave and all(x in wave for x in n)]
            go = bool(ready)
            for s in ready:
                text = own[s][0]
                for x in own[s][1]:
                    text = text.replace(f"{{{x}}}", answers[x])
                want[q, s] = (1 + max((wave[x] for x in own[s][1]), default=0), "answered", text, text.upper() if s % 3 else "")
            for s in ready:
                wave[s], answers[s] = want[q, s][0], want[q, s][3]

        def lost(s, seen=()):
            return any(x not in own or x not in seen and x not in wave and lost(x, (*seen, s)) for x in own[s][1])

        want |= {(q, s): (None, "missing" if lost(s) else "cycle", own[s][0], None) for s in own if s not in wave}
    assert {v[1] for v in want.values()} == {"answered", "missing", "cycle"} and max(v[0] or 0 for v in want.values()) > 3

    def answer(asked):
        return asked.where("sub_id % 3 <> 0").select("request_id", "sub_id", F.upper("question").alias("answer"))

    subs = spark.createDataFrame(rows, "request_id long, sub_id int, question string, needs array<int>").repartition(3)
    got = {(r.request_id, r.sub_id): (r.wave, r.status, r.question, r.answer) for r in waves.answered(subs.unionAll(subs), answer).collect()}
    assert got == want
    assert waves.answered(subs.limit(0), answer).collect() == []
    assert [r.status for r in waves.answered(spark.createDataFrame([(1, 1, "{1}", [1])], "request_id long, sub_id int, question string, needs array<int>"), answer).collect()] == ["cycle"]


def test_type_clusters_are_closed_likeness(spark):
    from larkspur.operators import heal

    rng = random.Random(8)
    names = {" ".join(rng.sample(["red", "green", "blue", "Big", "small", "old", "new", "the"], rng.randint(1, 5))) for _ in range(70)} | {"", "--", "RED green", "Red  GREEN"}
    rows = [(n,) for n in sorted(names) for _ in range(rng.randint(1, 4))] + [(None,)]
    for likeness in (0.6, 0.75, 1.0):
        found = {n: set(words(n)) for n in names}
        group = {n: n for n in names}
        go = True
        while go:
            go = False
            for a in names:
                for b in names:
                    if found[a] and found[b] and len(found[a] & found[b]) / len(found[a] | found[b]) >= likeness - 1e-12 and group[b] < group[a]:
                        group[a], go = group[b], True
        many = {n: sum(r == (n,) for r in rows) for n in names}
        want = {n: min((m for m in names if group[m] == group[n]), key=lambda m: (-many[m], m)) for n in names}
        got = {r.type: (r.canonical, r.n) for r in heal.normalised_types(spark.createDataFrame(rows, "type string"), likeness).collect()}
        assert got == {n: (want[n], many[n]) for n in names}


def test_cascade_is_plain_search_in_falling_steps(spark):
    import numpy as np

    from larkspur.operators import heal

    rng = np.random.default_rng(2)
    m = rng.normal(0, 1, (160, 4))
    source = [None if i % 11 == 0 else f"s{i % 4}" for i in range(160)]
    unit = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    cos = np.round(unit @ unit.T, 9)
    edges = [(f"v{i}", f"v{i + 1}") for i in range(0, 60, 2)]
    linked, want = {int(x[1:]) for e in edges for x in e}, set()
    for step in (0.99, 0.9, 0.6):
        made = set()
        for i in set(range(160)) - linked:
            hits = [(-cos[i, j], j) for j in linked if cos[i, j] >= step]
            own = [h for h in hits if source[i] is not None and source[h[1]] == source[i]]
            made |= {(f"v{i}", f"v{j}", round(float(-s), 4), f"{step:.2f}", bool(own)) for s, j in sorted(own or hits)[:2]}
        linked |= {int(x[1:]) for e in made for x in e[:2]}
        want |= made
    v = spark.createDataFrame([(f"v{i}", i, i, m[i].tolist(), source[i]) for i in range(160)], "id string, num long, pos long, vector array<double>, source string")
    got = {tuple(r) for r in heal.cascaded(v, spark.createDataFrame(edges, "src string, dst string"), (0.99, 0.9, 0.6)).collect()}
    assert got == want and len({w[3:] for w in want}) >= 4


def test_percentiles_go_on_from_range_to_range(spark):
    from larkspur.operators import usage

    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float(rng.randint(0, 40)), rng.random()])) for _ in range(3000)] + [("c", 7.0)] * 500 + [("d", None)]
    shares = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(rows, "phase string, sec double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.phase: tuple(r[k] for k in shares) for r in usage.percentiles(df, ["phase"], "sec", shares).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for phase in ("a", "b", None, "c"):
        own = sorted(s for p, s in rows if p == phase and s is not None)
        assert got[phase] == tuple(own[min(int(len(own) * q), len(own) - 1)] for q in shares.values())
    assert got.keys() == {"a", "b", None, "c"}


def test_names_of_marks_are_found_by_their_first(spark):
    from larkspur.operators import history

    texts = {1: "a ++ b", 2: "c+", 3: "++", 4: None, 5: "?! x", 6: "Alpha ++"}
    names = [("k", "++"), ("k", "+"), ("m", "?!"), ("k", "alpha"), ("k", "..")]
    got = {(r.id, r.kind): r.names for r in history.detected(spark.createDataFrame(list(texts.items()), "id long, text string"), spark.createDataFrame(names, "kind string, name string")).collect()}
    want = {}
    for i, t in texts.items():
        for kind, name in names:
            if t and name in t.lower():
                want.setdefault((i, kind), []).append(name)
    assert got == {k: sorted(v) for k, v in want.items()}
