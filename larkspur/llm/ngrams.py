"""Language-model scoring with an Elias-Fano n-gram trie.

Tokens are words of the text with A-Z lower-cased, then one end token; a token is
known by a 64-bit polynomial hash of its bytes over random values. The model is an interpolated, absolutely
discounted trigram model over one class for all unknown words:

    P1(w)     = (1 - m) (c(w) - d1) / (N - d1 V), unknown words together m
    P2(w|v)   = q((c(vw) - d) / c(v)) + g(v) P1(w)
    P3(w|u,v) = q((c(uvw) - d) / c(uv)) + g(u,v) P2(w|v)

with m the share of tokens that occur once (Good-Turing). Only bigrams and trigrams
that occur ``keep`` times or more have a first term (op9 keeps all); q rounds down
to one of 256 probabilities that each shard chooses for each order, and g is what the
kept terms of a context leave of 1, so each distribution sums to 1 whatever was
rounded or left out. All counts are exact, up to 64-bit collisions of words.
The discount of an order is given or estimated from how many of its n-grams occur
once and twice.

Building sums up the lengths of the texts and then takes two passes over them:

1. Tasks send sorted runs of (word hash, count) to shards by range of the hash, one
   binary row a run. A shard's words become an Elias-Fano file; a word's id is its
   place in the order of hashes over all shards.
2. Tasks send sorted runs of trigrams of ids to trie shards, dealt by the first word
   and, where that word is frequent, the second, so that no shard holds more than
   its share. Texts end in one more mark, so that the count of a bigram is the sum of its
   trigrams' counts, all of them in its own shard: no other n-gram is shuffled.
   Beyond ``direct`` shards, runs go by way of groups of shards and are merged
   there, so that they stay long however many shards there are.

A trie shard is a file of levels: contexts, pointers, successors relative to their
context; and the same below each bigram. When all shards have told how many n-grams
occur once and twice, each writes its probabilities beside, and what a word's bigrams
leave for its back-off is summed over the shards. What a shard holds is the same
wherever its runs come from and in whatever order.

Scoring maps the files and looks up all n-grams of many documents at once by
context-relative successor search; only pages that are used are in memory. Numbers
of shards follow from the length of the input, so no task grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.eliasfano import EliasFano, forget, map_arrays, write_arrays
from larkspur.shared import materialise, shared_path

#: Probabilities that a level of a shard may use.
LEVELS = 256
#: Tokens that are worked on at once; three local numbers of words fit in 64 bits.
WINDOW = 1 << 20


#: A random value for each byte; letters A-Z have those of a-z. No text holds bytes 254 and 255 (UTF-8 has neither).
VALUES = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)
VALUES[65:91] = VALUES[97:123]
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BASE = 0x9E3779B97F4A7C15 | 5
BLOCK = 1 << 20


class Powers:
    """Powers of BASE and of its inverse modulo 2^64."""

    up = np.ones(0, np.uint64)
    down = np.ones(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            made = []
            for base in (BASE, pow(BASE, -1, 1 << 64)):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                made.append(np.cumprod(factors, dtype=np.uint64))
            cls.up, cls.down = made
        return cls.up, cls.down


def finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def _block_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words of a block that begins and ends with white space."""
    up, down = Powers.of(len(raw))
    edges = np.flatnonzero(np.diff(SPACE[raw])) + 1
    start, stop = edges[::2], edges[1::2]
    total = np.cumsum(VALUES[raw] * up[: len(raw)], dtype=np.uint64)
    return finished((total[stop - 1] - total[start - 1]) * down[start])


def _long_hash(word: bytes) -> np.ndarray:
    """The hash of one word of any length, block by block."""
    total, up = 0, Powers.of(BLOCK)[0]
    for at in range(0, len(word), BLOCK):
        part = VALUES[np.frombuffer(word[at : at + BLOCK], np.uint8)]
        total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(BASE, at, 1 << 64)
    return finished(np.array([total % (1 << 64)], np.uint64))


def hash_words(raw: bytes) -> np.ndarray:
    """Hashes of all words (runs of other bytes than ASCII white space), with A-Z as a-z."""
    out, at = [], 0
    while at < len(raw):
        part = raw[at : at + BLOCK]
        if at + BLOCK < len(raw):
            cut = max(part.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:  # a word that no block holds
                stop = next((i for i in range(at + BLOCK, len(raw)) if SPACE[raw[i]]), len(raw))
                out.append(_long_hash(raw[at:stop]))
                at = stop
                continue
            part = part[: cut + 1]
        at += len(part)
        out.append(_block_hashes(np.frombuffer(b" " + part + b" ", np.uint8)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


#: The end of a text and what stands before its first word.
END_MARK, START_MARK = b"\xff", b"\xfe"
END, START = (hash_words(m)[0] for m in (END_MARK, START_MARK))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted keys, a place of each, and each place's number among them."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return keys[new], order[new], number


def starts_of(now: np.ndarray) -> np.ndarray:
    """Where texts start in a sequence of tokens."""
    return np.concatenate([[0], np.flatnonzero(now == END)[:-1] + 1]).astype(np.int64)


def tokens_of(texts: list[bytes]) -> np.ndarray:
    """Hashes of the tokens of all texts, each with its end."""
    return hash_words((b" " + END_MARK + b" ").join([*texts, b""]))


@dataclass
class Window:
    """Consecutive tokens by their number among ``words``, with the two before each."""

    at: slice
    words: np.ndarray
    start: int
    now: np.ndarray
    one: np.ndarray
    two: np.ndarray
    first: np.ndarray


def windows(now: np.ndarray, starts: np.ndarray) -> Iterator[Window]:
    mark = np.zeros(len(now), bool)
    mark[starts] = True
    for a in range(0, len(now), WINDOW):
        low, b = max(a - 2, 0), min(a + WINDOW, len(now))
        words, _, number = distinct(np.append(now[low:b], START))
        local, start = number[:-1], int(number[-1])
        one = np.concatenate([[start], local[:-1]])
        one[mark[low:b]] = start
        two = np.concatenate([[start], one[:-1]])
        cut = a - low
        yield Window(slice(a, b), words, start, local[cut:], one[cut:], two[cut:], mark[a:b])


def utf8(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def token_slices(texts: list[bytes], chars: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for at, text in enumerate(texts):
        if at > start and size + len(text) > chars:
            yield start, at
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


@dataclass
class Layout:
    """Where a model's files are and how many there are."""

    path: str
    unigram_bits: int
    #: Id of the first word of each unigram shard, and the number of all.
    firsts: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))
    tries: int = 1
    tokens: int = 0
    types: int = 0
    single: int = 0
    double: int = 0
    starts: int = 0
    start_id: int = -1
    discounts: dict = field(default_factory=lambda: {2: 0.75, 3: 0.75})
    facts: dict = field(default_factory=dict)

    @property
    def words(self) -> int:
        return int(self.firsts[-1])

    def unigram_shard(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.unigram_bits)).astype(np.int64) if self.unigram_bits else np.zeros(len(h), np.int64)

    def within(self, h: np.ndarray) -> np.ndarray:
        """Hashes without the bits that number their unigram shard."""
        return h & np.uint64((1 << 64 - self.unigram_bits) - 1)

    def trie_shard(self, u: np.ndarray, often: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Shards of bigrams: by range of the first word, over more shards the more often it occurs."""
        spread = np.clip(often * (8 * self.tries) // max(self.tokens, 1), 1, self.tries)
        turn = (v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        return (u * self.tries // max(self.words, 1) + turn % spread) % self.tries

    @property
    def unseen(self) -> float:
        """Share of all unknown words."""
        return min(0.5, max(self.single, 1) / (self.tokens + 1)) if self.tokens else 1.0

    @property
    def first_discount(self) -> float:
        return self.single / (self.single + 2 * self.double) if self.single else 0.0


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers in a sorted array."""
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
        if b > a:
            yield int(shard[a]), slice(a, b)


def changes(keys: np.ndarray) -> np.ndarray:
    """Where a sorted array has a new value."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their summed counts (how often each is there, if none are given)."""
    if counts is None:
        keys = np.sort(keys)
        first = changes(keys)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys)
    keys = keys[order]
    first = changes(keys)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts[:0]


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers below 2^64 as compressed planes of bytes."""
    out, sizes = [], []
    for a in arrays:
        a = a.astype("<u8")
        top = int(a.max(initial=0))
        width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
        out.append(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
        sizes += [len(a), width]
    return np.array([len(arrays), *sizes], "<i8").tobytes() + zstandard.compress(b"".join(out), 1)


def unpacked(raw: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", 2 * n, 8).tolist()
    data, at, out = zstandard.decompress(raw[8 + 16 * n :]), 0, []
    for size, width in zip(sizes[::2], sizes[1::2], strict=True):
        planes = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64))
        at += size * width
    return out


def steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences within groups; the first of each group as it is."""
    out = np.diff(values, prepend=values[:1])
    out[first] = values[first]
    return out


def from_steps(out: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.cumsum(out, dtype=np.uint64)
    base = total[first] - out[first]
    return total - np.repeat(base, np.diff(np.append(first, len(out))))


RUN = "shard int, run binary"


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary())], names=["shard", "run"])


def word_runs(docs: DataFrame, layout: Layout, chars: int = 4_000_000, hold: int = 2_000_000) -> DataFrame:
    """Runs of (word, count) of each task by unigram shard."""

    def emitted(held: list[tuple]) -> pa.RecordBatch:
        keys, counts = summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
        return _rows([(s, packed([np.diff(keys[at], prepend=np.uint64(0)), counts[at]])) for s, at in by_shard(layout.unigram_shard(keys))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            texts = utf8(batch)
            for a, b in token_slices(texts, chars):
                keys, counts = summed(np.append(tokens_of(texts[a:b]), START))
                counts[np.searchsorted(keys, START)] -= 1  # it has an id, but is never counted
                held.append((keys, counts))
                if sum(len(k) for k, _ in held) > hold:
                    yield emitted(held)
                    held = []
        if held:
            yield emitted(held)

    return docs.select("text").mapInArrow(run, RUN)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(shard, runs) of a partition that is sorted by shard."""
    at, held = None, []
    for batch in batches:
        for shard, run in zip(batch.column("shard").to_pylist(), batch.column("run"), strict=True):
            if shard != at:
                if held:
                    yield at, held
                at, held = shard, []
            held.append(run.as_py())
    if held:
        yield at, held


SUMS = "shard long, words long, n long, types long, single long, double long"


def _sums(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shard", "words", "n", "types", "single", "double"])


def dealt(runs: DataFrame, shards: int) -> DataFrame:
    """Every shard's runs in a partition of their own."""
    return runs.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")


def compact(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes, with the large ones apart."""
    large = np.flatnonzero(counts >= 255)
    return {"counts": np.minimum(counts, 255).astype(np.uint8), "large": large.astype(np.int64), "large_counts": counts[large].astype(np.int64)}


def counted(arrays: dict[str, np.ndarray], place: np.ndarray | slice) -> np.ndarray:
    """Counts at sorted or unsorted places of :func:`compact`'s arrays."""
    if isinstance(place, slice):
        place = np.arange(len(arrays["counts"]))[place]
    n = arrays["counts"][place].astype(np.int64)
    big = np.flatnonzero(n == 255)
    n[big] = arrays["large_counts"][np.searchsorted(arrays["large"], place[big])]
    return n


def add_words(runs: DataFrame, layout: Layout) -> DataFrame:
    """Writes the unigram files; one row of sums a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for shard, rows in _gathered(batches):
            parts = [unpacked(r) for r in rows]
            keys, counts = summed(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in parts]), np.concatenate([c for _, c in parts]).astype(np.int64))
            write_arrays(f"{layout.path}/unigrams-{shard}", EliasFano.build(layout.within(keys), 1 << 64 - layout.unigram_bits, "words") | compact(counts))
            out.append((shard, len(keys), int(counts.sum()), int((counts > 0).sum()), int((counts == 1).sum()), int((counts == 2).sum())))
        yield _sums(out)

    return dealt(runs, 1 << layout.unigram_bits).mapInArrow(run, SUMS)


class Unigrams:
    """Ids, exact counts and back-off weights of words, by mapped shards."""

    def __init__(self, layout: Layout, backoff: bool):
        self.layout, self.backoff = layout, backoff

    def look(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id (-1: unknown), count and back-off weight of sorted distinct words."""
        ids, counts, weights = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64), np.ones(len(words))
        for shard, at in by_shard(self.layout.unigram_shard(words)):
            if self.layout.firsts[shard] == self.layout.firsts[shard + 1]:
                continue  # no training word has such a hash
            arrays = map_arrays(f"{self.layout.path}/unigrams-{shard}")
            place = EliasFano(arrays, "words").find(self.layout.within(words[at]))
            hit = np.flatnonzero(place >= 0)
            place = place[hit]
            ids[at.start + hit] = self.layout.firsts[shard] + place
            counts[at.start + hit] = counted(arrays, place)
            if self.backoff:
                weights[at.start + hit] = map_arrays(f"{self.layout.path}/backoff-{shard}")["weights"][place]
        return ids, counts, weights

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids; the start mark counts the texts."""
        out = np.zeros(len(ids), np.int64)
        for shard, at in by_shard(np.searchsorted(self.layout.firsts, ids, side="right") - 1):
            out[at] = counted(map_arrays(f"{self.layout.path}/unigrams-{shard}"), ids[at] - self.layout.firsts[shard])
        out[ids == self.layout.start_id] = self.layout.starts
        return out


def _runs(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, shard: np.ndarray) -> list[tuple[int, bytes]]:
    """Runs by shard of trigrams that are sorted within each shard."""
    order = np.argsort(shard.astype(np.uint32), kind="stable")
    u, v, w, n, out = u[order], v[order], w[order], n[order], []
    for s, at in by_shard(shard[order]):
        a, b, c = u[at], v[at], w[at]
        pairs = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        a, b = a[pairs], b[pairs]
        heads = changes(a)
        out.append((s, packed([np.diff(a[heads], prepend=np.uint64(0)), np.diff(np.append(heads, len(a))), steps(b, heads), np.diff(np.append(pairs, len(c))), steps(c, pairs), n[at]])))
    return out


def _trigrams(raw: bytes) -> list[np.ndarray]:
    """First, second and third words and counts of a run."""
    heads, many2, second, many3, third, n = unpacked(raw)
    many2, many3 = many2.astype(np.int64), many3.astype(np.int64)
    b = from_steps(second, np.cumsum(many2) - many2)
    c = from_steps(third, np.cumsum(many3) - many3)
    return [np.repeat(np.repeat(np.cumsum(heads, dtype=np.uint64), many2), many3), np.repeat(b, many3), c, n.astype(np.int64)]


def _merged(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct first words; bigrams (place of the first, second); trigrams (place of the bigram, third, count)."""
    u, v, w, n = (np.concatenate(c) for c in zip(*map(_trigrams, runs), strict=True))
    heads, _, place = distinct(u)
    bits = np.uint64(int(max(v.max(initial=0), w.max(initial=0))).bit_length())
    pairs, _, place = distinct(place.astype(np.uint64) << bits | v)
    keys, n = summed(place.astype(np.uint64) << bits | w, n)
    mask = np.uint64((1 << int(bits)) - 1)
    return heads, (pairs >> bits).astype(np.int64), pairs & mask, (keys >> bits).astype(np.int64), keys & mask, n


def gram_runs(docs: DataFrame, layout: Layout, fan: int, chars: int = 8_000_000) -> DataFrame:
    """Runs of trigrams by trie shard, or by group of ``fan`` shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigrams, bits = Unigrams(layout, False), np.uint64(21)
        mask = np.uint64((1 << 21) - 1)
        for batch in batches:
            texts = utf8(batch)
            for a, b in token_slices(texts, chars):
                now = tokens_of(texts[a:b])
                for x in windows(now, starts_of(now)):
                    ids, often, _ = unigrams.look(x.words)
                    often[x.start] = layout.starts
                    one, two, own = (k.astype(np.uint64) for k in (x.one, x.two, x.now))
                    ends = np.flatnonzero(now[x.at] == END)
                    inner = np.flatnonzero(~x.first)
                    keys = np.concatenate([((two << bits | one) << bits | own)[inner], ((one << bits | own) << bits | np.uint64(x.start))[ends]])
                    keys, n = summed(keys)
                    u, v, w = (ids[(k & mask).astype(np.int64)] for k in (keys >> bits + bits, keys >> bits, keys))
                    shard = layout.trie_shard(u, often[(keys >> bits + bits).astype(np.int64)], v) // fan
                    yield _rows(_runs(u.astype(np.uint64), v.astype(np.uint64), w.astype(np.uint64), n, shard))

    return docs.select("text").mapInArrow(run, RUN)


def regrouped(runs: DataFrame, layout: Layout, fan: int, salts: int, hold: int = 24 << 20) -> DataFrame:
    """Runs by trie shard from runs by group of shards: those of a group meet, in parts, and are merged."""

    def split(held: list[bytes]) -> pa.RecordBatch:
        heads, first, v, pair, w, n = _merged(held)
        u, v = heads[first][pair], v[pair]
        often = Unigrams(layout, False).counts_of(heads.astype(np.int64))
        return _rows(_runs(u, v, w, n, layout.trie_shard(u.astype(np.int64), often[first][pair], v.astype(np.int64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _gathered(batches):
            held: list[bytes] = []
            for row in rows:
                held.append(row)
                if sum(map(len, held)) > hold:
                    yield split(held)
                    held = []
            if held:
                yield split(held)

    groups = -(-layout.tries // fan)
    salted = runs.repartitionById(groups * salts, F.col("shard") * salts + F.pmod(F.xxhash64("run"), F.lit(salts)).cast("int"))
    return salted.sortWithinPartitions("shard").mapInArrow(run, RUN)


def build_tries(runs: DataFrame, layout: Layout, keep: int) -> DataFrame:
    """Writes the trie files with their counts; two rows of sums a shard, ``words`` being the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(layout.path)
        out = []
        for shard, rows in _gathered(batches):
            heads, first, second, pair, third, n = _merged(rows)
            rows.clear()
            n2 = np.bincount(pair, n, len(second)).astype(np.int64)
            real = third != layout.start_id  # what follows an end is no trigram
            for order, counts in ((2, n2), (3, n[real])):
                out.append((shard, order, int(counts.sum()), int((counts >= keep).sum()), int((counts == 1).sum()), int((counts == 2).sum())))
            often = n2 >= keep
            mine = np.flatnonzero(real & (n >= keep))
            place = np.cumsum(often) - 1
            first, second, n2 = first[often], second[often], n2[often]
            pair, third, n = place[pair[mine]], third[mine], n[mine]
            arrays = EliasFano.build(heads, layout.words, "contexts")
            arrays |= EliasFano.build(np.searchsorted(first, np.arange(len(heads) + 1)), len(second) + 1, "pointers2")
            arrays |= EliasFano.build(first.astype(np.uint64) * np.uint64(layout.words) + second, max(len(heads), 1) * layout.words, "level2")
            arrays |= EliasFano.build(np.searchsorted(pair, np.arange(len(second) + 1)), len(third) + 1, "pointers3")
            arrays |= EliasFano.build(pair.astype(np.uint64) * np.uint64(layout.words) + third, max(len(second), 1) * layout.words, "level3")
            write_arrays(f"{layout.path}/trie-{shard}", arrays)
            write_arrays(f"{layout.path}/counts-{shard}", {f"{k}{order}": a for order, c in ((2, n2), (3, n)) for k, a in compact(c).items()})
        yield _sums(out)

    return dealt(runs, layout.tries).mapInArrow(run, SUMS)


def palette(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most LEVELS probabilities and the code of each value, rounded down to one of them.

    Half of them are the most frequent values; the others part the rest evenly.
    """
    values, number, many = np.unique(p, return_inverse=True, return_counts=True)
    if len(values) > LEVELS:
        most = np.argsort(-many, kind="stable")[: LEVELS // 2]
        rest = np.delete(np.arange(len(values)), most)
        chosen = np.union1d(most, rest[np.arange(LEVELS // 2 - 1) * len(rest) // (LEVELS // 2 - 1)])
        chosen = np.union1d(chosen, [0])
        return values[chosen], (np.searchsorted(chosen, np.arange(len(values)), side="right") - 1)[number].astype(np.uint8)
    return values, number.astype(np.uint8)


#: Steps of what a context leaves.
LEFT = 65535


def add_probabilities(layout: Layout, spark) -> DataFrame:
    """Writes the probabilities of every trie shard; runs of (word, mass) by unigram shard that its bigrams take."""

    def shard_masses(shard: int) -> list[tuple[int, bytes]]:
        try:
            arrays, counts = (map_arrays(f"{layout.path}/{kind}-{shard}") for kind in ("trie", "counts"))
        except FileNotFoundError:
            return []  # no n-gram is there
        n2, n3 = (counted({k: counts[f"{k}{order}"] for k in ("counts", "large", "large_counts")}, slice(None)) for order in (2, 3))
        contexts, first2, first3 = (e.access(np.arange(e.n)).astype(np.int64) for e in (EliasFano(arrays, k) for k in ("contexts", "pointers2", "pointers3")))
        often = Unigrams(layout, False).counts_of(contexts)
        values2, codes2 = palette((n2 - layout.discounts[2]) / np.maximum(np.repeat(often, np.diff(first2)), n2))
        values3, codes3 = palette((n3 - layout.discounts[3]) / np.maximum(np.repeat(n2, np.diff(first3)), n3))
        left = np.ones(len(n2)) - np.bincount(np.repeat(np.arange(len(n2)), np.diff(first3)), values3[codes3], len(n2))
        write_arrays(f"{layout.path}/probabilities-{shard}", {"values2": values2, "codes2": codes2, "values3": values3, "codes3": codes3, "left": np.round(np.clip(left, 0, 1) * LEFT).astype(np.uint16)})
        mass = np.bincount(np.repeat(np.arange(len(contexts)), np.diff(first2)), values2[codes2], len(contexts))
        home = np.searchsorted(layout.firsts, contexts, side="right") - 1
        return [(s, packed([np.diff(contexts[at], prepend=0), np.round(mass[at] * 2**31).astype(np.int64)])) for s, at in by_shard(home)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(layout.path)
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                yield _rows(shard_masses(shard))

    return spark.range(0, layout.tries, 1, layout.tries).mapInArrow(run, RUN)


def write_backoff(masses: DataFrame, layout: Layout) -> None:
    """Writes the back-off weight of every word beside its unigram file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _gathered(batches):
            if (size := int(layout.firsts[shard + 1] - layout.firsts[shard])) == 0:
                continue
            mass = np.zeros(size, np.int64)
            for row in rows:
                if row:
                    words, own = unpacked(row)
                    np.add.at(mass, np.cumsum(words).astype(np.int64) - layout.firsts[shard], own.astype(np.int64))
            write_arrays(f"{layout.path}/backoff-{shard}", {"weights": np.clip(1 - mass / 2**31, 0, 1).astype(np.float32)})
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["n"])

    # every shard has a file, words without a successor in it included
    every = masses.sparkSession.range(1 << layout.unigram_bits).select(F.col("id").cast("int").alias("shard"), F.lit(b"").alias("run"))
    dealt(masses.unionAll(every), 1 << layout.unigram_bits).mapInArrow(run, "n long").count()


def estimated_discount(single: int, double: int) -> float:
    """Absolute discount from counts of counts; 0.75 if none occurs once or none twice."""
    return single / (single + 2 * double) if single and double else 0.75


def build(docs: DataFrame, keep: int = 2, discount: float | None = 0.75, shard_tokens: int = 3_000_000, trie_grams: int = 3_000_000, direct: int = 2_000) -> Layout:
    """Builds a model of the texts of ``docs`` (null: empty) in the shared folder.

    Without ``discount`` each order has its own, estimated from its counts of counts.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    layout = Layout(shared_path(spark, "ngrams"), max(0, (chars // (24 * shard_tokens)).bit_length()))
    found = sorted(materialise(add_words(word_runs(docs, layout), layout), "ngram-words").collect())
    if not found:
        return layout
    sizes = np.zeros(1 << layout.unigram_bits, np.int64)
    sizes[[r["shard"] for r in found]] = [r["words"] for r in found]
    layout.firsts = np.concatenate([[0], np.cumsum(sizes)])
    layout.tokens, layout.types, layout.single, layout.double = (sum(r[c] for r in found) for c in ("n", "types", "single", "double"))
    (end,), (layout.starts,) = (a.tolist() for a in Unigrams(layout, False).look(np.array([END]))[:2])
    layout.start_id = int(Unigrams(layout, False).look(np.array([START]))[0][0])
    layout.tries = 1 + layout.tokens // min(trie_grams, shard_tokens)
    fan = 1 if layout.tries <= direct else int(layout.tries**0.5)
    runs = gram_runs(docs, layout, fan)
    if fan > 1:
        runs = regrouped(runs, layout, fan, salts=fan)
    grams = materialise(build_tries(runs, layout, keep), "ngram-sums").groupBy("words").agg(*[F.sum(c).alias(c) for c in ("n", "types", "single", "double")]).collect()
    layout.facts = {r["words"]: r["types"] for r in grams}
    layout.discounts = {r["words"]: estimated_discount(r["single"], r["double"]) if discount is None else discount for r in grams}
    write_backoff(add_probabilities(layout, spark), layout)
    return layout


class Scorer:
    """Scores documents with a built model."""

    def __init__(self, layout: Layout):
        self.layout, self.unigrams = layout, Unigrams(layout, True)
        forget(layout.path)

    def shards(self, shard: np.ndarray) -> Iterator[tuple[dict, dict, np.ndarray]]:
        """(trie, probabilities, positions) of each shard in use."""
        order = np.argsort(shard.astype(np.uint32), kind="stable")
        for s, at in by_shard(shard[order]):
            try:
                yield *(map_arrays(f"{self.layout.path}/{kind}-{s}") for kind in ("trie", "probabilities")), order[at]
            except FileNotFoundError:
                continue  # no n-gram was kept there

    def score(self, texts: list[bytes]) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, model score) of each text."""
        L = self.layout
        now = tokens_of(texts)
        starts = starts_of(now)
        known, base, own = np.zeros(len(now), np.int64), np.zeros(len(now)), np.zeros(len(now))
        for x in windows(now, starts):
            ids, counts, weights = self.unigrams.look(x.words)
            n = counts[x.now]
            known[x.at] = n > 0
            base[x.at] = np.log10((n + 0.1) / (L.tokens + 0.1 * (L.types + 1)))
            if L.tokens:
                p = np.where(n > 0, (1 - L.unseen) * (n - L.first_discount) / max(L.tokens - L.first_discount * L.types, 1e-9), L.unseen)
                own[x.at] = np.log10(np.maximum(self._interpolated(x, ids, counts, weights[x.one] * p), 1e-300))
        size = np.diff(np.append(starts, len(now)))
        return list(zip(size.tolist(), *(np.add.reduceat(c, starts).tolist() for c in (known, base, own)), strict=True))

    def _interpolated(self, x: Window, ids: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Adds bigrams to what back-off leaves, then trigrams."""
        L = self.layout
        bits = np.uint64(len(x.words).bit_length())
        mask = np.uint64((1 << int(bits)) - 1)
        now, one, two = (k.astype(np.uint64) for k in (x.now, x.one, x.two))
        # bigrams in the order of their ids; the last is that before the first token
        pairs, _, back = distinct(np.append(one << bits | now, two[:1] << bits | one[:1]))
        u, v = (pairs >> bits).astype(np.int64), (pairs & mask).astype(np.int64)
        often = counts.copy()
        often[x.start] = L.starts
        place, gain, home = np.full(len(pairs), -1, np.int64), np.zeros(len(pairs)), np.zeros(len(pairs), np.int64)
        ask = np.flatnonzero((often[u] > 0) & (counts[v] > 0))
        home[ask] = L.trie_shard(ids[u[ask]], often[u[ask]], ids[v[ask]])
        for trie, given, at in self.shards(home[ask]):
            at = ask[at]
            first = changes(u[at])
            context = np.repeat(EliasFano(trie, "contexts").find(ids[u[at[first]]]), np.diff(np.append(first, len(at))))
            hit = np.flatnonzero(context >= 0)
            found = EliasFano(trie, "level2").find(context[hit].astype(np.uint64) * np.uint64(L.words) + ids[v[at[hit]]].astype(np.uint64))
            hit, found = at[hit[found >= 0]], found[found >= 0]
            place[hit], gain[hit] = found, given["values2"][given["codes2"][found]]
        p = p + gain[back[:-1]]
        # trigrams below the bigram that ends at the token before
        node = np.concatenate([back[-1:], back[:-2]])
        ask = np.flatnonzero(~x.first & (place[node] >= 0))
        keys, _, back = distinct(node[ask].astype(np.uint64) << bits | now[ask])
        node, w = (keys >> bits).astype(np.int64), (keys & mask).astype(np.int64)
        gain, left = np.zeros(len(keys)), np.zeros(len(keys))
        for trie, given, at in self.shards(home[node]):
            own = place[node[at]]
            left[at] = given["left"][own] / LEFT
            at, own = at[counts[w[at]] > 0], own[counts[w[at]] > 0]
            found = EliasFano(trie, "level3").find(own.astype(np.uint64) * np.uint64(L.words) + ids[w[at]].astype(np.uint64))
            hit, found = at[found >= 0], found[found >= 0]
            gain[hit] = given["values3"][given["codes3"][found]]
        p[ask] = gain[back] + left[back] * p[ask]
        return p


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, layout: Layout, fold: int = 0, folds: int = 10, chars: int = 4_000_000) -> DataFrame:
    """Scores every document with a built model.

    Null and empty texts are one end token; equal texts get equal scores; without
    training text every token is unknown with probability 1; an empty table gives
    no rows; other columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(layout)
        for batch in batches:
            texts = utf8(batch)
            out = [row for a, b in token_slices(texts, chars) for row in scorer.score(texts[a:b])]
            size, known, base, own = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [], [])
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array([layout.tokens] * len(out), pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, SCORED)


def build_on_fold(docs: DataFrame, fold: int = 0, folds: int = 10, **options) -> Layout:
    """Learns from the documents outside one fold of crc32(doc_id)."""
    outside = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds != fold, F.lit(True))
    return build(docs.where(outside), **options)
