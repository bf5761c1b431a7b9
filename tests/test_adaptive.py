"""Routes and drafts that retrieve, against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from larkspur.operators import adaptive, lexical


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def test_outcomes_are_the_shortest_that_suffice(spark):
    rng = random.Random(3)
    rows = [(q, n, rng.choice([None, 0.0, 0.5, 0.8, 0.9, 1.0])) for q in range(60) for n in range(3)]
    want = {}
    for q in range(60):
        shares = [x or 0.0 for i, _, x in rows if i == q]
        want[q] = next((n for n, x in enumerate(shares) if x >= 0.8), shares.index(max(shares)))
    got = adaptive.outcomes(spark.createDataFrame(rows, "query_id long, route int, coverage double"), 0.8).collect()
    assert {r["query_id"]: r["route"] for r in got} == want
    assert adaptive.outcomes(spark.createDataFrame([], "query_id long, route int, coverage double"), 0.8).isEmpty()


def plain_route(train, features, routes=3, buckets=8):
    clip = lambda b: min(max(b or 0, 0), buckets - 1)
    n = Counter(r for r, _ in train)
    hits = Counter((r, f, clip(b)) for r, fs in train for f, b in enumerate(fs))
    scores = [math.log((n[r] + 1) / (len(train) + routes)) + sum(math.log((hits[r, f, clip(b)] + 1) / (n[r] + buckets)) for f, b in enumerate(features)) for r in range(routes)]
    scores = [round(s, 9) for s in scores]
    best = scores.index(max(scores))
    return best, round(1 / sum(math.exp(s - max(scores)) for s in scores), 6)


@pytest.mark.parametrize("n", [0, 1, 200])
def test_routes_follow_the_counts(spark, n):
    rng = random.Random(n)
    odd = [None, -4, 0, 1, 2, 5, 7, 9, 40]
    train = [(r, [r + rng.randint(0, 2), rng.choice(odd)]) for r in (rng.choice([0, 1, 1, 2]) for _ in range(n))]
    asked = [(q, [rng.randint(0, 5), rng.choice(odd)]) for q in range(50)]
    model = adaptive.fit(spark.createDataFrame(train, "route int, features array<int>"), 2)
    assert model.count() == 3 + 3 * 2 * 8
    got = adaptive.routed(model, spark.createDataFrame(asked, "query_id long, features array<int>")).collect()
    assert len(got) == len(asked)
    for r in got:
        route, confidence = plain_route(train, asked[r["query_id"]][1])
        assert r["route"] == route
        assert r["confidence"] == pytest.approx(confidence, abs=2e-6)


def plain_active(spans, docs, least, rounds):
    held_words = {i: words(t) for i, t in docs}
    n, mean = len(docs), sum(map(len, held_words.values())) / len(docs)
    df = Counter(w for ws in held_words.values() for w in set(ws))

    def score(asked, ws):
        tf = Counter(ws)
        return sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in asked if tf[w])

    drafts = defaultdict(list)
    for q, s, t in sorted(spans, key=lambda x: x[:2]):
        drafts[q].append((s, set(words(t))))
    out = {}
    for q, parts in drafts.items():
        found, at, taken = {}, -1, []
        sure = lambda ws: len(ws & {w for i in taken for w in held_words[i]}) / len(ws) if ws else 1.0  # noqa: B023, E731
        for number in range(1, rounds + 1):
            unsure = [(s, ws) for s, ws in parts if s > at and sure(ws) < least]
            if not unsure:
                break
            at, ws = unsure[0]
            hits = sorted((-round(score(sorted(ws), held_words[i]), 9), i) for i, _ in docs if i not in taken and ws & set(held_words[i]))
            found[at] = number, hits[0][1] if hits else None
            taken += [hits[0][1]] if hits else []
        for s, ws in parts:
            out[q, s] = (round(sure(ws), 9), *found.get(s, (None, None)))
    return out


def texts(rng, n, size):
    return [" ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx".split()) + rng.choice(["", rng.choice("12345678")]) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("rounds", [0, 1, 3, 9])
def test_drafts_retrieve_where_they_are_unsure(spark, rounds):
    rng = random.Random(rounds)
    docs = list(enumerate([None, "", *texts(rng, 40, 30), "zz"]))
    spans = [(q, s, t) for q in range(12) for s, t in enumerate(texts(rng, rng.randint(1, 6), 9))]
    spans += [(50, 0, None), (51, 0, "never seen"), (52, 0, "zz"), (52, 1, "zz zz"), (52, 4, "ab1 cd2 nowhere")]
    want = plain_active(spans, docs, 0.8, rounds)
    got = adaptive.active(spark.createDataFrame(spans, "query_id long, span int, text string"), spark.createDataFrame(docs, "id long, text string"), 0.8, rounds).collect()
    assert {(r["query_id"], r["span"]): (round(r["confidence"], 9), r["round"], r["id"]) for r in got} == want
    assert max([r["round"] or 0 for r in got]) <= rounds


def test_empty_tables(spark):
    spans, docs = spark.createDataFrame([], "query_id long, span int, text string"), spark.createDataFrame([], "id long, text string")
    assert adaptive.active(spans, docs).isEmpty()
    some = spark.createDataFrame([(1, 0, "ab cd")], "query_id long, span int, text string")
    assert [tuple(r) for r in adaptive.active(some, docs).collect()] == [(1, 0, 0.0, 1, None)]
    asked = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "query_id long, query string")
    held = spark.createDataFrame([(1, "ab ab"), (2, "cd")], "id long, text string")
    found = {r["query_id"]: r["features"] for r in adaptive.question_features(lexical.index(held, asked), asked).collect()}
    assert found[2] == found[3] == [0, 0, 0, 0]
    assert found[1] == [0, 1, 0, 0]  # idf of one of two documents is log 2
