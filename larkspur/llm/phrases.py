"""Collocations: phrases of several words that occur together, by language.

Every shard of texts gets a generalised suffix automaton over its pieces, of bounded
depth: a state for each distinct factor of up to ``depth`` words, laid out level by level in
sorted arrays. The transition from a factor by one word is its key folded with the
word's; the suffix link of a factor is the one without its first word, which ends at the
same places and maybe others; the root is the empty factor and ends at every word, so its
endpos count is the number of words. Endpos counts are how often a key stands in its level.
The keys are 64-bit hashes of language and words, alike in all shards.

1. Each shard sends its factors and endpos counts to buckets by range of the key, as one
   sorted run a bucket, and writes its words to a file in the shared folder.
2. A bucket adds the counts up, run by run, in memory that its distinct keys bound. Every part of a phrase
   occurs as often as the phrase at least, so only keys with ``least`` occurrences go on. Each names
   one of the shards that hold it.
3. These shards look their keys up in their automata and return the phrases with the keys of
   all parts that a cut leaves, which are joined with the counts.

A phrase is subsumed if a longer candidate holds it and occurs nearly as often. Counts
never grow along an extension, so it is enough to look at extensions by one word: each
candidate is held against the factor of its suffix link and against the one without its last word.

A null text is empty, a null language is ``und``; repeated rows count each time; an empty
table gives no rows; other columns are ignored. Texts are taken whole: long ones are cut
between pieces, over which no phrase goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.eliasfano import map_arrays, write_arrays
from larkspur.llm.words import finished, slices, span_hashes
from larkspur.shared import materialise, shared_path

#: What ends a piece, and what ends a word within it.
BREAKS = ".,;:!?\n\x0b\x0c\r"
BREAK = np.isin(np.arange(256), [ord(c) for c in BREAKS])
GAP = BREAK | np.isin(np.arange(256), [9, 32])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CUT = re.compile(f"[{BREAKS}]")
#: Characters of a shard.
SHARD = 6_000_000
#: Bytes of text for each bucket of keys; keys that a task holds before it adds them up.
BUCKET_BYTES, PENDING = 6_000_000, 1_500_000
#: Unequal odd factors for the two sides of a transition.
LEFT, RIGHT = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def root_key(lang: str) -> np.ndarray:
    """Key of the empty factor of a language."""
    raw = np.frombuffer(lang.encode("utf-8", "surrogatepass"), np.uint8)
    return finished(span_hashes(raw, np.array([0]), np.array([len(raw)])) + RIGHT)


def extended(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of factors that go on by a word."""
    return finished(keys * LEFT + words * RIGHT)


def cut_texts(texts: list[str], langs: list[str], chars: int) -> tuple[list[str], list[str]]:
    """Texts longer than ``chars`` as several, cut after the end of a piece."""
    out, of = [], []
    for text, lang in zip(texts, langs, strict=True):
        at = 0
        while len(text) - at > chars and (found := CUT.search(text, at + chars)):
            out.append(text[at : found.end()])
            of.append(lang)
            at = found.end()
        out.append(text[at:])
        of.append(lang)
    return out, of


@dataclass
class Shard:
    """Words of some texts in order: hash of each, its piece, its language, and how the distinct ones read."""

    hashes: np.ndarray
    number: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    langs: list[str]
    words: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(texts: list[str], langs: list[str]) -> Shard:
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = LOWER[np.frombuffer(b"\n".join(parts), np.uint8)]
        edges = np.flatnonzero(np.diff(GAP[data], prepend=True, append=True))
        start, stop = edges[::2], edges[1::2]
        every = span_hashes(data, start, stop)
        hashes, first, number = np.unique(every, return_index=True, return_inverse=True)
        names = list(dict.fromkeys(langs))
        place = {lang: i for i, lang in enumerate(names)}
        doc = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, side="right")
        size = stop[first] - start[first]
        ends = np.cumsum(size)
        words = data[np.repeat(start[first] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        lang = np.array([place[x] for x in langs], np.int32)[doc]
        piece = np.cumsum(BREAK[data], dtype=np.int32)[start] if len(start) else np.empty(0, np.int32)
        return Shard(hashes, number.astype(np.int32), piece, lang, names, words, ends)

    def arrays(self) -> dict[str, np.ndarray]:
        """What is written; the columns are packed, as every word is in them."""
        steps = np.diff(self.piece, prepend=0).astype(np.int32), np.diff(self.lang, prepend=0).astype(np.int32)
        names = np.frombuffer("\x00".join(self.langs).encode("utf-8", "surrogatepass"), np.uint8)
        packed = {"number": self.number, "piece": steps[0], "lang": steps[1], "words": self.words}
        return {k: np.frombuffer(squeezed(a), np.uint8) for k, a in packed.items()} | {"hashes": self.hashes, "ends": self.ends, "langs": names}

    @staticmethod
    def read(uri: str) -> Shard:
        a = map_arrays(uri)
        number, piece, lang = (widened(a[k].tobytes(), np.int32) for k in ("number", "piece", "lang"))
        langs = a["langs"].tobytes().decode("utf-8", "surrogatepass").split("\x00")
        return Shard(a["hashes"], number, np.cumsum(piece, dtype=np.int32), np.cumsum(lang, dtype=np.int32), langs, widened(a["words"].tobytes(), np.uint8), a["ends"])

    def levels(self, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of the factors of 1, 2, ... words, and where each ends: one level of the automaton from the one before."""
        roots = np.concatenate([root_key(x) for x in self.langs]) if self.langs else np.empty(0, np.uint64)
        own = self.hashes[self.number]
        ends = np.arange(len(own))
        keys = extended(roots[self.lang], own) if len(own) else own
        yield keys, ends
        whole = np.zeros(len(own), np.uint64)
        for m in range(2, depth + 1):
            whole[ends] = keys
            ends = ends[ends > 0]
            ends = ends[(ends >= m - 1) & (self.piece[np.maximum(ends - m + 1, 0)] == self.piece[ends])]
            keys = extended(whole[ends - 1], own[ends])
            yield keys, ends

    def counted(self, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted keys of a level and their endpos counts, the roots' last."""
        for keys, _ in self.levels(depth):
            yield np.unique(keys, return_counts=True)
        n = np.bincount(self.lang, minlength=len(self.langs))
        roots = np.concatenate([root_key(x) for x in self.langs])
        order = np.argsort(roots)
        yield roots[order][n[order] > 0], n[order][n[order] > 0]

    def runs(self, depth: int, bits: int) -> Iterator[list[tuple[int, bytes]]]:
        """(bucket, run) of all levels, one level after another, a few at a time."""
        for keys, counts in self.counted(depth):
            bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]]).tolist() if len(keys) else [0]
            for at in range(0, len(edges) - 1, 64):
                yield [(int(bucket[x]), packed_run(keys[x:y], counts[x:y])) for x, y in zip(edges[at : at + 64], edges[at + 1 : at + 65], strict=False)]

    def phrase(self, end: int, words: int) -> str:
        """The words up to and with that at ``end``."""
        picked = self.number[end - words + 1 : end + 1].tolist()
        return b" ".join(self.words[self.ends[i - 1] if i else 0 : self.ends[i]].tobytes() for i in picked).decode("utf-8", "surrogatepass")


def squeezed(a: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, packed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def widened(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed_run(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts as one run."""
    first = squeezed(np.diff(keys, prepend=np.uint64(0)))
    return len(first).to_bytes(4, "little") + first + squeezed(counts.astype(np.uint32))


def read_run(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(raw[:4], "little")
    return np.cumsum(widened(raw[4 : 4 + size], np.uint64), dtype=np.uint64), widened(raw[4 + size :], np.uint32).astype(np.int64)


def shard_runs(docs: DataFrame, path: str, depth: int, bits: int) -> DataFrame:
    """Writes the shards; a row for each of them and each bucket of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, langs = cut_texts(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), SHARD)
            for a, b in slices(texts, rows=len(texts), chars=SHARD):
                shard, name = Shard.of(texts[a:b], langs[a:b]), part << 32 | no
                if not len(shard.number):
                    continue
                no += 1
                write_arrays(f"{path}/shard-{name}", shard.arrays())
                for at in shard.runs(depth, bits):
                    columns = zip(*((bucket, name, raw) for bucket, raw in at), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "shard", "run"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return rows.mapInArrow(run, "bucket int, shard long, run binary")


def added(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the counts of runs (keys, counts, shards) by key, with one of the key's shards, spread over them all."""
    keys, counts, shards = (np.concatenate(c) for c in zip(*runs, strict=True))
    runs.clear()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    many = np.diff(np.append(first, len(keys)))
    picked = first + (keys[first] % np.maximum(many, 1).astype(np.uint64)).astype(np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts, shards[order[picked]]


def frequent(runs: DataFrame, least: int) -> DataFrame:
    """Keys of ``least`` or more occurrences over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "shard", "run")), strict=True)

        for _, group in groupby(rows(), key=lambda r: r[0]):
            held, pending, names = [], 0, {}
            for _, shard, raw in group:
                keys, counts = read_run(raw)
                held.append((keys, counts, np.full(len(keys), names.setdefault(shard, len(names)), np.int32)))
                pending += len(keys)
                if pending > PENDING:
                    held = [added(held)]
                    pending = 0
            keys, counts, shards = added(held)
            keep = counts >= least
            every = np.array(list(names), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(counts[keep]), pa.array(every[shards[keep]])], names=["key", "n", "shard"])

    return runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, n long, shard long")


FACTORS = "key long, n long, lang string, words int, phrase string, heads array<long>, tails array<long>"


def factors(keys: DataFrame, path: str, depth: int) -> DataFrame:
    """The phrases of keys, from the shards that they name, with the keys of their parts.

    ``heads`` are the keys of the first 1, 2, ... words and ``tails`` those of what follows
    them: the first tail is the factor of the suffix link. Roots have no words.
    """

    def look(shard: Shard, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        wanted = np.argsort(keys)
        sorted_keys = keys[wanted]
        hint = np.zeros(1 << 20, bool)
        hint[(keys >> np.uint64(44)).astype(np.int64)] = True
        whole: list[np.ndarray] = []
        for lang in shard.langs:
            at = int(np.searchsorted(sorted_keys, root := root_key(lang)[0]))
            if at < len(keys) and sorted_keys[at] == root:
                yield int(root.view(np.int64)), int(counts[wanted[at]]), lang, 0, "", [], []
        for m, (own, ends) in enumerate(shard.levels(depth), 1):
            level = np.zeros(len(shard.number), np.uint64)
            level[ends] = own
            whole.append(level)
            likely = np.flatnonzero(hint[(own >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(sorted_keys, own[likely]), len(keys) - 1)
            hit = sorted_keys[at] == own[likely]
            number, first = np.unique(at[hit], return_index=True)
            for i, end in zip(number.tolist(), ends[likely[hit][first]].tolist(), strict=True):
                heads = [int(whole[k - 1][end - m + k].view(np.int64)) for k in range(1, m)]
                tails = [int(whole[m - k - 1][end].view(np.int64)) for k in range(1, m)]
                yield int(sorted_keys[i].view(np.int64)), int(counts[wanted[i]]), shard.langs[shard.lang[end]], m, shard.phrase(end, m), heads, tails

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "n")), strict=True)

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        names = ["key", "n", "lang", "words", "phrase", "heads", "tails"]
        for name, group in groupby(rows(), key=lambda r: r[0]):
            asked = np.array([r[1:] for r in group], np.int64)
            out = list(look(Shard.read(f"{path}/shard-{name}"), asked[:, 0].view(np.uint64), asked[:, 1]))
            for at in range(0, len(out), 10_000):
                columns = zip(*out[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return keys.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, FACTORS)


def counted(docs: DataFrame, least: int = 30, depth: int = 4) -> DataFrame:
    """All factors of up to ``depth`` words with ``least`` or more occurrences, as a written table."""
    spark = docs.sparkSession
    path = shared_path(spark, "phrase-shards")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (size // BUCKET_BYTES).bit_length()
    keys = frequent(shard_runs(docs, path, depth, bits), least)
    return materialise(factors(keys, path, depth), "phrase-factors")


def mine(docs: DataFrame, least: int = 30, depth: int = 4, most: int = 2000, share: int = 80) -> DataFrame:
    """The first ``most`` phrases of each language.

    Of the cuts of a phrase the one with the lowest score counts, the first of equal ones.
    A phrase is left out if a longer candidate that holds it occurs ``share`` percent as often.
    """
    found = counted(docs, least, depth)
    counts = found.select(F.col("key").alias("of"), F.col("n").cast("decimal(20,0)").alias("times"))
    each = F.explode(F.transform(F.arrays_zip("heads", "tails"), lambda x, i: F.struct((i + 1).alias("k"), x.heads.alias("head"), x.tails.alias("tail"))))
    cuts = found.where("words >= 2").select("key", "words", F.col("n").alias("a"), each.alias("cut")).select("key", "words", "a", "cut.*")
    heads, tails = (counts.select(F.col("of").alias(side), F.col("times").alias(name)) for side, name in (("head", "l"), ("tail", "r")))
    cuts = materialise(cuts.join(heads, "head").join(tails, "tail"), "phrase-cuts")
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (l + r)")
    best = cuts.groupBy("key").agg(F.min(F.struct(score.alias("score"), "k", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))).alias("best"))
    longer = cuts.where("words > 2").withColumn("enough", F.col("a").cast("decimal(20,0)") * 100)
    links = longer.where("k = 1").where(F.col("enough") >= F.col("r") * share).select(F.col("tail").alias("key"))
    links = links.unionAll(longer.where("k = words - 1").where(F.col("enough") >= F.col("l") * share).select(F.col("head").alias("key"))).distinct()
    rows = found.where("words >= 2").select("key", "lang", "phrase", F.col("n").alias("a")).join(links, "key", "left_anti").join(best, "key")
    rows = rows.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # first within parts of a language, of which each leaves ``most`` rows at most: no task sorts a whole language
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    n = found.where("words = 0").select("lang", F.col("n"))
    return rows.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH T AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), W AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM T
), N AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM W GROUP BY lang
), G AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM W, (VALUES (1), (2), (3), (4)) AS D(m) WHERE len(w) >= m
), F AS (
  SELECT lang, phrase, m, count(*) AS f FROM G GROUP BY lang, phrase, m HAVING count(*) >= 30
), C AS (
  SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM F WHERE m > 1
), Q AS (
  SELECT lang, phrase, m, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM C)
), K AS (
  SELECT Q.lang, Q.phrase, k, a, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM Q JOIN F x ON x.lang = Q.lang AND x.phrase = head JOIN F y ON y.lang = Q.lang AND y.phrase = tail
), B AS (
  SELECT lang, phrase, min(a) AS a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM K GROUP BY lang, phrase
), I AS (
  SELECT lang, m, a, z, unnest(list_transform(range(1, m - z + 2), lambda i: array_to_string(w[i:i + z - 1], ' '))) AS part FROM (SELECT *, unnest(range(2, m)) AS z FROM C)
), X AS (
  SELECT DISTINCT I.lang, F.phrase FROM I JOIN F ON F.lang = I.lang AND F.phrase = part WHERE 100::HUGEINT * a >= 80::HUGEINT * f
), R AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM B ANTI JOIN X USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM R JOIN N USING (lang) WHERE rank <= 2000
"""
