"""Sequence packing by large-item matching with best-fit gaps.

Pieces above one third of the capacity are *large*: a bin holds at most two of
them. They are paired by greedy matching (largest with the largest partner that
still fits); smaller pieces then go, in falling size, to the smallest gap that
takes them, or open new bins.

Sizes are integers up to the capacity, so the whole plan follows from a
histogram of at most ``capacity`` rows, however many documents there are. The
driver plans runs of equal bins over that histogram. Every run is halved in gap
each time it is visited, so the plan has O(capacity * log(capacity)) rows; this
bound does not depend on the data and the plan can be broadcast. Executors place
each piece by its rank among pieces of its size.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.words import WORD_CACHE, WordMemo, slices
from larkspur.shared import materialise

#: Splits lower-cased text as the vocabulary's own pre-tokenizer does.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Characters on which Python and the tokenizer may differ (controls, special-token marks, contextual case, marks that compose).
UNUSUAL = regex.compile(r"[\x00-\x08\x0e-\x1f\x7f-\xa0<\u03a3\u0130\p{M}]|[^\x00-\u024f]")


#: Pre-tokens that a worker remembers.
PIECE_CACHE = 400_000
#: Letters up to here have one lower-case form each, but for U+0130.
LATIN = "\u024f"


def pretokens(word: str) -> list[str]:
    """Lower-cased pre-tokens of a word, with short cuts for letters and for one mark after them."""
    if word.isalpha():
        return [word.lower()]
    if word[:-1].isalpha() and word[-1] in ".,;:!?|)":
        return [word[:-1].lower(), word[-1]]
    return PRETOKEN.findall(word.lower())


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder(WordMemo):
    """Ids of whole texts from ids of their space-separated words.

    The vocabulary's pre-tokenizer never joins text across white space and its
    last token of a pre-token carries a word-end mark, so the ids of a text are
    those of its words in turn, and new words can be encoded many at a time.
    Words and pre-tokens are remembered per worker, within a fixed bound.
    """

    def __init__(self, path: str, cache: int = WORD_CACHE):
        super().__init__(self._learn, cache)
        self.path, self.pieces, self.most = path, {}, min(cache, PIECE_CACHE)
        self.ends: np.ndarray | None = None

    def _slow(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in _tokenizer(self.path).encode_batch(words, add_special_tokens=False)]

    def _learn_pieces(self, new: list[str]) -> None:
        if self.ends is None:
            vocabulary = _tokenizer(self.path).get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            ids = np.array(_tokenizer(self.path).encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and (not len(ids) or stops[-1] == len(ids)):
                raw, start = ids.tobytes(), 0
                for piece, stop in zip(some, stops.tolist(), strict=True):
                    self.pieces[piece] = raw[4 * start : 4 * stop]
                    start = stop
            else:
                self.pieces |= dict(zip(some, self._slow(some), strict=True))

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as bytes: little-endian unsigned 32-bit numbers."""
        if len(self.pieces) > self.most:
            self.pieces = {}
        odd = [w for w in words if not w.isascii() and (max(w) > LATIN or "\u0130" in w) or not w[:-1].isalpha() and UNUSUAL.search(w)]
        slow = dict(zip(odd, self._slow(odd), strict=True))
        cut = [() if w in slow else pretokens(w) for w in words]
        self._learn_pieces(list({p for c in cut for p in c if p not in self.pieces}))
        pieces = self.pieces
        return [slow[w] if w in slow else b"".join([pieces[p] for p in c]) for w, c in zip(words, cut, strict=True)]


def vocabulary_path(vocabulary: str) -> str:
    """A path as it is, or a file of the public tokenizers by name; resolved where it is used."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"


def token_pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenises every document and cuts those longer than ``capacity``.

    ``part`` and ``nth`` number the pieces of one length within an input
    partition; with the per-partition counts they give each piece a global rank
    without sorting or gathering anything.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, end = WordEncoder(vocabulary_path(vocabulary)), {}, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = batch.to_pydict()
            out = []
            texts = [t or "" for t in rows["text"]]
            encoded = (ids for start, stop in slices(texts) for ids in encoder.encode(texts[start:stop]))
            for doc, part, ids in zip(rows["doc_id"], rows["part"], encoded, strict=True):
                ids += end
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, capacity)):
                    length = min(capacity, total - start)
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    out.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, nth))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().cast("long").alias("part"))
    return rows.mapInArrow(cut, PIECES)


def plan_bins(histogram: dict[int, int], capacity: int = 4096) -> list[tuple[int, int, int, int, int]]:
    """Rows (size, first rank, pieces a bin, first bin, offset) from counts by size.

    The piece of rank r (counted within its size) lies in the row with the last
    first rank <= r: bin = first bin + (r - first rank) // pieces a bin, at offset
    + ((r - first rank) % pieces a bin) * size.
    """
    left = {s: n for s, n in histogram.items() if n}
    rank = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    bins = 0

    def add(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, many))

    def take(size: int, many: int, each: int, first: int, offset: int) -> None:
        plan.append((size, rank[size], each, first, offset))
        rank[size] += many

    large = sorted(s for s in left if 3 * s > capacity)
    waiting = {s: left[s] for s in large}
    alive = large[:]
    while alive:
        size = alive[-1]
        if not waiting[size]:
            alive.pop()
            continue
        at = bisect.bisect_right(alive, capacity - size) - 1
        while at >= 0 and (not waiting[alive[at]] or alive[at] == size and waiting[size] < 2):
            if not waiting[alive[at]]:
                alive.pop(at)
            at -= 1
        if at < 0:  # nothing fits beside it
            many = waiting[size]
            take(size, many, 1, bins, 0)
            add(capacity - size, bins, many)
        elif (other := alive[at]) == size:
            many = waiting[size] // 2
            take(size, 2 * many, 2, bins, 0)
            waiting[size] -= 2 * many
            add(capacity - 2 * size, bins, many)
            bins += many
            continue
        else:
            many = min(waiting[size], waiting[other])
            take(size, many, 1, bins, 0)
            take(other, many, 1, bins, size)
            waiting[other] -= many
            add(capacity - size - other, bins, many)
        waiting[size] -= many
        bins += many

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        many = left[size]
        while many:
            at = bisect.bisect_left(order, size)
            if at == len(order):  # new bins, as empty as each other
                add(capacity, bins, new := -(-many // (capacity // size)))
                bins += new
                continue
            gap = order[at]
            first, wide = gaps[gap].pop()
            each = gap // size
            full = min(wide, many // each)
            if full:
                take(size, full * each, each, first, capacity - gap)
                add(gap - each * size, first, full)
                many -= full * each
            rest = many if full < wide else 0
            if rest:  # the last of them, fewer than a bin takes
                take(size, rest, rest, first + full, capacity - gap)
                add(gap - rest * size, first + full, 1)
                many = 0
                full += 1
            add(gap, first + full, wide - full)
            if not gaps[gap]:
                del gaps[gap]
                order.pop(bisect.bisect_left(order, gap))
    return plan


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Packs all documents; one row per piece.

    Null and empty texts are one end id; equal rows are packed as often as they
    occur; an empty table gives no rows; other columns of ``docs`` are ignored.
    Texts are tokenised once and never shuffled: only their pieces are.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, vocabulary, capacity, end_id), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = np.array(plan_bins(histogram, capacity) or np.empty((0, 5)), dtype=np.int64)
    plan = spark.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        wide = int(rows[:, 1].max(initial=0)) + 1
        keys = rows[:, 0] * wide + rows[:, 1] if (capacity + 1) * wide < 2**62 else None
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            if keys is not None:
                at = np.searchsorted(keys, length * wide + np.minimum(rank, wide - 1), side="right") - 1
            else:
                at = np.array([bisect.bisect_right(rows[:, :2].tolist(), [a, b]) - 1 for a, b in zip(length, rank, strict=True)], dtype=np.int64)
            size, first, each, start, offset = rows[at].T
            step = rank - first
            got = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            got |= {"sequence_id": pa.array(start + step // each), "offset": pa.array(offset + step % each * size)}
            yield pa.RecordBatch.from_pydict(got)

    ranked = pieces.join(base.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, PLACED)
