"""Size-partitioned MinHash containment search for benchmark items in documents.

Words are runs of letters, digits and underscores of the lower-cased text;
shingles are five consecutive words (an item of fewer words: the whole sequence; none: no
shingle). An item is found in a document that holds at least ``threshold`` of
its distinct shingles: one of fewer words, in every document that holds them in turn.

Items are partitioned by size (powers of two of their distinct shingles). An
item's sketch is its k smallest shingle hashes, k being one more than the misses
that the threshold allows at the partition's upper size. An item of size n may
miss at most floor((1 - threshold) * n) shingles, so every document that
qualifies holds at least one shingle of the sketch: the search loses nothing,
however long the document. Every shingle of a document, of five words and of each
smaller number that some item has, probes the sketches; the pairs that meet are verified
on the words themselves.

Sketches and item words are broadcast in blocks of at most ``block_words`` words
of items; a larger benchmark takes further passes over the documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.words import WordMemo, slices

WORD = re.compile(r"\w+")
#: Odd multipliers, so that a shingle's hash depends on the order of its words.
MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(1, 65)], np.uint64)


def word_hashes(words: list[str]) -> list[bytes]:
    digest = xxhash.xxh64_digest
    lowered = [x.lower() for x in words]
    return [digest(x) if x.isalpha() else b"".join([digest(w) for w in WORD.findall(x)]) for x in lowered]


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words (of the whole sequence, if shorter)."""
    width = min(width, len(hashes))
    if not width:
        return hashes
    n = len(hashes) - width + 1
    return reduce(np.add, (hashes[j : j + n] * MULTIPLIERS[j] for j in range(width))) + np.uint64(width)


def shingles(text: str, width: int) -> set[tuple[str, ...]]:
    words = WORD.findall(text.lower())
    width = min(width, len(words))
    return set(zip(*(words[j : len(words) - width + 1 + j] for j in range(width)), strict=True)) if words else set()


class Sketches:
    """The items of one block: their shingles and the table of sketch hashes."""

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float):
        self.width, self.threshold = width, Fraction(str(threshold))
        self.items = [(i, s) for i, text in items if (s := shingles(text or "", width))]
        self.sizes = [len(next(iter(s))) for _, s in self.items]  # words of their shingles
        self.widths = sorted(set(self.sizes))
        memo, found = WordMemo(word_hashes), defaultdict(list)
        for at, (_, own) in enumerate(self.items):
            upper = (1 << len(own).bit_length()) - 1
            keep = int((1 - self.threshold) * upper) + 1
            flat = np.frombuffer(b"".join(memo.encode([" ".join(s) for s in own])), "<u8").reshape(len(own), -1)
            hashes = np.unique(np.concatenate([shingle_hashes(row, width) for row in flat]))
            for h in hashes[:keep].tolist():
                found[h].append(at)
        self.hashes = np.array(sorted(found), np.uint64)
        self.owners = [found[h] for h in self.hashes.tolist()]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, text: str, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, its shingles, those that the text holds) of each item found."""
        widths = [w for w in self.widths if w <= len(hashes)]
        own = np.concatenate([shingle_hashes(hashes, w) for w in widths]) if widths else hashes[:0]
        own = own[self.seen[(own >> np.uint64(44)).view(np.int64)]] if len(self.hashes) else own[:0]
        if not len(own):
            return []
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        hit = np.unique(at[self.hashes[at] == own])
        if not len(hit):
            return []
        held, found = {w: shingles(text, w) for w in widths}, []
        for item in sorted({i for h in hit.tolist() for i in self.owners[h]}):
            name, wanted = self.items[item]
            if (shared := len(wanted & held.get(self.sizes[item], set()))) >= self.threshold * len(wanted):
                found.append((name, len(wanted), shared))
        return found


def _blocks(benchmark: DataFrame, width: int, threshold: float, block_words: int) -> Iterator[Broadcast]:
    """Broadcasts the items in blocks of bounded size; the driver holds one at a time."""
    held, words = [], 0
    send = benchmark.sparkSession.sparkContext.broadcast
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        words += len((row["text"] or "").split()) + 1
        if words >= block_words:
            yield send(Sketches(held, width, threshold))
            held, words = [], 0
    if held:
        yield send(Sketches(held, width, threshold))


def _searched(batch: pa.RecordBatch, column: int, sketches: Sketches, memo: WordMemo) -> Iterator[tuple[int, list]]:
    texts = [t or "" for t in batch.column(column).to_pylist()]
    for start, stop in slices(texts):
        for at, raw in enumerate(memo.encode(texts[start:stop]), start):
            if found := sketches.matches(texts[at], np.frombuffer(raw, "<u8")):
                yield at, found


FOUND = "doc_id long, item_id long, item_shingles long, shared_shingles long, containment double"


def contained(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, block_words: int = 2_000_000) -> DataFrame:
    """One row per document and benchmark item that it holds.

    Null and empty texts hold nothing; equal rows give a row each; an empty
    benchmark or document table gives no rows; other columns are ignored.
    Documents are read once per block and never shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for block in _blocks(benchmark, width, threshold, block_words):

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            memo = WordMemo(word_hashes)
            for batch in batches:
                ids, out = batch.column(0).to_pylist(), []
                for at, found in _searched(batch, 1, block.value, memo):
                    out += [(ids[at], item, size, shared, shared / size) for item, size, shared in found]
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (*[pa.int64()] * 4, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "item_shingles", "shared_shingles", "containment"])

        parts.append(rows.mapInArrow(search, FOUND))
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, block_words: int = 2_000_000) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item.

    Null and empty texts hold none and stay; repeated rows stay or go alike; with an empty
    benchmark, or one without a word, all stay; an empty table stays empty. Texts are
    searched whole, in the rows where they lie; columns of any names stay as they are.
    """
    column = docs.columns.index("text")
    for block in _blocks(benchmark, width, threshold, block_words):

        def keep(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            memo = WordMemo(word_hashes)
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                mask[[at for at, _ in _searched(batch, column, block.value, memo)]] = False
                yield batch.filter(pa.array(mask))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') FROM benchmark
), widths AS (
  SELECT DISTINCT least(len(w), 5) AS z FROM words WHERE kind = 'b' AND len(w) > 0
), shingled AS (
  SELECT kind, r, id, unnest(list_distinct(list_transform(range(1, len(w) - z + 2), lambda i: array_to_string(w[i:i + z - 1], ' ')))) AS s
  FROM words JOIN widths ON len(w) >= z AND (kind = 'd' OR z = least(len(w), 5))
), sizes AS (
  SELECT r, count(*) AS n FROM shingled WHERE kind = 'b' GROUP BY r
), shared AS (
  SELECT d.r, any_value(d.id) AS doc_id, b.r AS item, any_value(b.id) AS item_id, count(*) AS k
  FROM shingled d JOIN shingled b ON d.s = b.s AND d.kind = 'd' AND b.kind = 'b' GROUP BY d.r, b.r
)
SELECT doc_id, item_id, n AS item_shingles, k AS shared_shingles, k / n AS containment
FROM shared JOIN sizes ON sizes.r = item WHERE k * 10 >= n * 8
"""
