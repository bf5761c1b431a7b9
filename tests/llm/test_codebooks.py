"""Vector codes against plain integer arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from larkspur.llm import codebooks

KIND = "vec_id long, embedding array<float>, label int, code string, data binary, n long"


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    wide = length // parts
    vs = [v + [0] * (length - len(v)) for _, v, _ in kept]
    cut = [[v[p * wide : (p + 1) * wide] for p in range(parts)] for v in vs]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(s, book):
        return min((sum((a - b) ** 2 for a, b in zip(s, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            drawn = {}
            for c in cut:
                drawn.setdefault(best(c[p], books[p])[1], []).append(c[p])
            new.append([[sum(col) // len(drawn[k]) for col in zip(*drawn[k])] if k in drawn else e for k, e in enumerate(books[p])])
        books = new
    out, sums = [], {}
    for (i, _, lab), c in zip(kept, cut):
        found = [best(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
        sums[lab] = sums.get(lab, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, err, sums[lab], sha) for i, code, err, lab in out), key=repr)


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, "c", b"d", 1) for r in rows], KIND).repartition(5)
    return sorted((tuple(r) for r in codebooks.compress(df, **options).collect()), key=repr)


def test_codes_equal_plain_arithmetic(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.4, 32)], None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(300)]
    rows += rows[:20] + [(1000 + i, rows[0][1], 1) for i in range(150)]  # repeated rows and one very common vector
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, parts=4, entries=5, rounds=3) == plain(rows, 4, 5, 3)


def test_odd_rows(spark):
    v = [0.25] * 20
    rows = [(1, v, 1), (1, v, 1), (1, [-0.001] * 20, None), (2, None, 1), (3, [float("nan")] + v[1:], 1), (4, v[1:] + [float("inf")], 1), (5, [None] + v[1:], 1), (None, [0.5] * 20, None), (6, [], 2), (7, [1.0, -2.0], 2)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, [r for r in rows if r[0] in (2, 3)]) == []
    assert codebooks.compress(spark.createDataFrame([], KIND)).collect() == []
    huge = got(spark, [(1, [3e38, -3e38], 1), (2, [0.0, 0.0], 1)])
    assert [r[2] for r in huge] == [0, 0]


def test_floors_go_down_and_ties_go_to_the_first(spark):
    rows = [(1, [0.0, 0.0], 0), (2, [2 / 256, -2 / 256], 0), (3, [1 / 256, -1 / 256], 0), (4, [-3.5 / 256, 0.0], 0)]
    assert got(spark, rows, parts=2, entries=2, rounds=1) == plain(rows, 2, 2, 1)


def test_decoding_is_near(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 16)], 0) for i in range(40)]
    df = spark.createDataFrame([(*r, "c", b"d", 1) for r in rows], KIND)
    kept = codebooks.kept(df)
    data = codebooks.blocks(kept, 16)
    books = codebooks.fit(kept, data, 16)
    for r in codebooks.codes(data, books).collect():
        assert np.allclose(books.decode(r.code), rows[r.vec_id][1], atol=1 / 256)
    with pytest.raises(ValueError):
        codebooks.fit(kept, data, 16, entries=257)
