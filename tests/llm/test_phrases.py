"""Collocations against counting every phrase, and the automaton's levels against enumeration."""

import random
import re
from collections import Counter

import numpy as np

from larkspur.llm import phrases

KIND = "doc_id long, text string, lang string, key long, n long, phrase string, words int"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def pieces(text):
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER))]


def plain(rows, least=30, depth=4, most=2000, share=80):
    counts, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for p in pieces(text):
            n[lang] += len(p)
            for m in range(1, depth + 1):
                own.update(tuple(p[i : i + m]) for i in range(len(p) - m + 1))
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {p for q, b in found.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1) if (p := q[i:j]) != q and 100 * b >= share * found[p]}
        kept = []
        for p, a in found.items():
            if p not in gone:
                score, _, l, r = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, 6, "p", 7) for r in rows], KIND).repartition(5)


def corpus(seed, n=300, vocabulary=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["New York", "new york City", "É x", "日本"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "; "]) for _ in range(rng.randint(0, 80)))
        out.append((i, rng.choice([None, ""]) if i % 17 == 0 else text, rng.choice(["en", "en", "de", None, "und"])))
    return out


def test_mined_phrases_equal_counting(spark):
    rows = corpus(1, 900, 5)
    want = plain(rows)
    assert len(want) > 60 and sorted(map(tuple, phrases.mine(table(spark, rows)).collect())) == want


def test_bounds_and_depth(spark):
    rows = corpus(2, 200)
    for options in ({"least": 3, "depth": 3, "most": 20}, {"least": 10, "depth": 2, "share": 100}, {"least": 1, "depth": 4, "share": 50, "most": 5}):
        assert sorted(map(tuple, phrases.mine(table(spark, rows), **options).collect())) == plain(rows, **options)


def test_small_shards_and_buckets_change_nothing(spark, monkeypatch):
    rows = corpus(3, 120)
    want = sorted(map(tuple, phrases.mine(table(spark, rows), least=5).collect()))
    docs = table(spark, rows)
    for name, value in (("SHARD", 200), ("BUCKET_BYTES", 500), ("PENDING", 50)):
        monkeypatch.setattr(phrases, name, value)
    runs = phrases.shard_runs(docs, phrases.shared_path(spark, "phrase-shards"), 4, 3).collect()
    assert {r["bucket"] for r in runs} == set(range(8)) and len({r["shard"] for r in runs}) > 20
    assert sorted(map(tuple, phrases.mine(docs, least=5).collect())) == want == plain(rows, least=5)


def test_levels_are_the_factors():
    rows = corpus(4, 40)
    shard = phrases.Shard.of([t or "" for _, t, _ in rows], [x or "und" for _, _, x in rows])
    want = Counter((x or "und", tuple(p[i : i + m])) for _, t, x in rows for p in pieces(t) for m in range(1, 5) for i in range(len(p) - m + 1))
    got, keys = Counter(), {}
    for m, (level, ends) in enumerate(shard.levels(4), 1):
        for key, end in zip(level.tolist(), ends.tolist()):
            factor = (shard.langs[shard.lang[end]], tuple(shard.phrase(end, m).split(" ")))
            got[factor] += 1
            assert keys.setdefault(key, factor) == factor
    assert got == want and len(keys) == len(want)


def test_runs_and_sums():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 500, dtype=np.uint64))
    counts = rng.integers(1, 2**32, len(keys))
    back = phrases.read_run(phrases.packed_run(keys, counts))
    assert (back[0] == keys).all() and (back[1] == counts).all()
    some, many = rng.integers(0, 9, 100).astype(np.uint64), rng.integers(1, 5, 100)
    got = phrases.added([(some[:40], many[:40], np.arange(40)), (some[40:], many[40:], np.arange(40, 100))])
    assert dict(zip(got[0].tolist(), got[1].tolist())) == {k: int(many[some == k].sum()) for k in set(some.tolist())}
    assert all(some[s] == k for k, s in zip(got[0].tolist(), got[2].tolist()))


def test_odd_tables(spark):
    assert phrases.mine(spark.createDataFrame([], KIND)).collect() == []
    assert phrases.mine(table(spark, [(1, None, None), (2, "", "en"), (None, " . ", None)])).collect() == []
    rows = [(1, "same two words. " * 40, None)] + [(2, "same two words", "und")] * 5 + [(3, "one" * 100_000, "en"), (4, "a b " * 50_000, "en")]
    assert sorted(map(tuple, phrases.mine(table(spark, rows)).collect())) == plain(rows)
