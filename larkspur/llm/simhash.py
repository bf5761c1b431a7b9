"""SimHash near-duplicate groups by BK-trees over shards of fingerprints.

Fingerprints come from 4-word shingles (see :func:`fingerprint`). Equal
fingerprints become one before any search, so copies cost nothing further.

Removing copies (:func:`deduplicated`) takes pairs of words and a wider radius, as 4-word
shingles tell texts apart by 8 bits and more that share four fifths of their 5-word
shingles. What chance brings that near among very many fingerprints is held back by a second, independent
fingerprint of the same shingles, which must be near, too.

Two fingerprints that differ in at most ``radius`` of 64 bits agree on at least
``blocks - radius`` of ``blocks`` bit blocks. Every choice of that many blocks
gives a table of shards keyed by the bits of those blocks, so each linked pair
meets in some shard. In a shard a BK-tree is grown over its fingerprints: the
children of a node are keyed by their Hamming distance to it, and a search
follows only edges within the radius of its own distance. A shard returns a star for
each of its groups, at most one link less than it has fingerprints, never all
pairs of a group. As a group meets in many tables, a fingerprint then keeps its smallest
centre only, to which its other centres are linked.

A shard of over ``shard_size`` fingerprints is split into pieces, and each pair of
pieces is a task of its own: the tree of one piece is asked for the other's
members, in blocks of bounded size. Groups are then closed by minimum-label
propagation with pointer jumping over written tables.

Tables that grow with the input are joined by merging: Spark sizes what is read by its compressed
files, and a table's rows once a fingerprint, so it would broadcast them far above its threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from larkspur.shared import looked_up, materialise

SHINGLE, SEED, BITS = 4, 42, 64
#: Seed of the second fingerprint.
CHECK_SEED = 43
#: Ids that may be broadcast.
FEW = 100_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set in over half the XXH64 of the text's shingles.

    A-Z are lower-cased; words stand between ASCII white space; shingles are ``shingle``
    words joined by spaces, repeats included; fewer words give the whole sequence,
    none gives zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
    width = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[width:], strict=False)])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    total = bits.sum(axis=0, dtype=np.int64) if len(bits) > 255 else bits.sum(axis=0, dtype=np.uint8).astype(np.int64)
    return int.from_bytes(np.packbits(2 * total > len(bits)).tobytes(), "big")


class BKTree:
    """A metric tree under Hamming distance; equal members are kept once."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return
        at = 0
        while True:
            distance = (self.values[at] ^ value).bit_count()
            if not distance:
                return
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return
            at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the members within the radius."""
        if not self.values:
            return []
        found, open_ = [], [0]
        while open_:
            at = open_.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            if children := self.children[at]:
                low, high = distance - radius, distance + radius
                open_ += [child for edge, child in children.items() if low <= edge <= high]
        return found


class Groups:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def shard_links(left: list[int], right: list[int] | None, radius: int, checks: dict[int, int] | None = None, check_radius: int = 0) -> list[tuple[int, int]]:
    """Links that join the groups of one piece, or of two, of a shard.

    With ``checks``, the second fingerprint of each, these must be within ``check_radius``, too.
    """
    tree, out = BKTree(), []
    place = {v: i for i, v in enumerate(left + (right or []))}
    groups = Groups(len(place))

    def search(value: int) -> None:
        for at in tree.within(value, radius):
            other = tree.values[at]
            if checks is not None and (checks[value] ^ checks[other]).bit_count() > check_radius:
                continue
            if groups.join(place[value], place[other]):
                out.append((other, value))

    if right is None:
        for value in left:
            search(value)
            tree.add(value)
    else:
        for value in left:
            tree.add(value)
        for value in right:
            search(value)
    return out


def stars(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same groups as (member, smallest member)."""
    place = {v: i for i, v in enumerate(sorted({v for link in found for v in link}))}
    groups = Groups(len(place))
    for a, b in found:
        groups.join(place[a], place[b])
    values = list(place)
    return [(v, values[groups.root(i)]) for i, v in enumerate(values) if groups.root(i) != i]


def _keys(fp: Column, blocks: int, radius: int) -> list[Column]:
    """A 64-bit key of each table: the chosen blocks' bits, hashed with the table's number."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = [reduce(int.__or__, chosen) for chosen in combinations(masks, blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in signed]
    return [F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(m))) for n, m in enumerate(signed)]


def links(prints: DataFrame, radius: int = 4, blocks: int = 6, shard_size: int = 2000, check_radius: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``; enough of them to join every group, of each ``a`` one but for centres of stars.

    With ``check_radius`` a second one of each, ``check``, must be that near, too.
    """
    check = F.lit(0).cast("long") if check_radius is None else F.col("check")
    keyed = prints.select("fp", check.alias("check"), F.explode(F.array(*_keys(F.col("fp"), blocks, radius))).alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    full = full.select("key", F.ceil(F.col("n") / shard_size).cast("int").alias("pieces"))
    held = keyed.join(full.hint("merge"), "key")
    own = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    dealt = held.withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("second"), "fp", "check")
    # a piece meets itself in (own, own), where it is sent once
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "second", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: np.ndarray) -> list[tuple[int, int]]:
            fps, second = rows["fp"].tolist(), rows["second"]
            cut = int(len(fps) - second.sum())
            alone = rows["low"][0] == rows["high"][0]
            checks = None if check_radius is None else dict(zip(fps, rows["check"].tolist(), strict=True))
            return stars(shard_links(fps[:cut], None if alone else fps[cut:], radius, checks, check_radius or 0))

        kind = np.dtype([("key", np.int64), ("low", np.int32), ("high", np.int32), ("second", bool), ("fp", np.uint64), ("check", np.uint64)])
        kept = np.empty(0, kind)
        for batch in [*batches, None]:
            if batch is not None:
                rows = np.empty(batch.num_rows, kind)
                for name in kind.names:
                    values = batch.column(name).to_numpy(zero_copy_only=False)
                    rows[name] = values.view(np.uint64) if name in ("fp", "check") else values
                kept = np.concatenate([kept, rows])
            if not len(kept):
                continue
            change = (kept["key"][1:] != kept["key"][:-1]) | (kept["low"][1:] != kept["low"][:-1]) | (kept["high"][1:] != kept["high"][:-1])
            starts = [0, *(np.flatnonzero(change) + 1).tolist()]
            stops = [*starts[1:], len(kept)]
            if batch is not None:  # the last shard may go on in the next batch
                last = starts.pop()
                stops.pop()
            out = [link for a, b in zip(starts, stops, strict=True) if b - a > 1 for link in done(kept[a:b])]
            kept = kept[last:] if batch is not None else kept[:0]
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    found = dealt.mapInArrow(search, "a long, b long")
    # a fingerprint has a centre a table and pair of pieces at most
    centres = found.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("centres"))
    least = F.get("centres", F.lit(0))
    kept = F.transform("centres", lambda c, i: F.struct(F.when(i == 0, F.col("a")).otherwise(c).alias("a"), least.alias("b")))
    return centres.select("a", F.explode(kept).alias("link")).select("link.a", "link.b").distinct()


def components(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(fp, label) of every linked fingerprint: the smallest ``first`` of its group.

    ``ids`` has (fp, first), ``first`` being of any type that can be ordered. Labels fall along links and are then followed to the
    label of their label, so that the number of rounds grows with the logarithm of the longest chain. A label
    that very many fingerprints share is followed by broadcast.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")), "simhash-links")
    nodes = both.select(F.col("a").alias("fp")).distinct()
    labels = materialise(nodes.join(ids.hint("merge"), "fp").select("fp", F.col("first").alias("label")), "simhash-labels")
    while True:
        near = both.join(labels.select(F.col("fp").alias("b"), "label").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.hint("merge"), labels.fp == near.a, "left").select("fp", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        lower = materialise(lower, "simhash-lower")
        # every label is some linked fingerprint's own: follow it one step
        owners = lower.join(ids.select("fp", "first").hint("merge"), "fp").groupBy(F.col("first").alias("label")).agg(F.min("label").alias("next"))
        after = materialise(looked_up(lower, owners, "label").select("fp", "was", F.least("label", "next").alias("label")), "simhash-labels")
        labels = after.select("fp", "label")
        if after.where(F.col("label") != F.col("was")).isEmpty():
            return labels


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, checked: bool = False) -> DataFrame:
    """(doc_id, fp, check) of every row; fp is the fingerprint as a signed number, check a second one (0 unless ``checked``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, batch.num_rows)
            check = np.fromiter((fingerprint(t.as_py() or b"", shingle, CHECK_SEED) if checked else 0 for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64)), pa.array(check.view(np.int64))], names=["doc_id", "fp", "check"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long, check long")


def grouped(docs: DataFrame, radius: int, blocks: int, shard_size: int, shingle: int = SHINGLE, check_radius: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, label) of every fingerprint.

    ``label`` is the smallest (doc_id, fp) of the group, so that groups that share a
    doc_id stay apart; its doc_id is null if no row of the group has one.
    """
    prints = materialise(fingerprints(docs, shingle, check_radius is not None), "simhash-prints")
    lowest = F.struct(F.coalesce(F.min("doc_id"), F.lit(2**63 - 1)).alias("id"), "fp").alias("first")
    ids = materialise(prints.groupBy("fp").agg(lowest, F.min("check").alias("check")), "simhash-distinct")
    edges = materialise(links(ids, radius, blocks, shard_size, check_radius), "simhash-edges")
    owner = ids.select("fp", F.col("first").alias("label"))
    if not edges.isEmpty():
        owner = owner.join(components(edges, ids).withColumnRenamed("label", "joined").hint("merge"), "fp", "left").select("fp", F.coalesce("joined", "label").alias("label"))
    named = F.when(F.col("label.id") < 2**63 - 1, F.col("label.id"))
    return prints, owner.select("fp", F.struct(named.alias("id"), F.col("label.fp").alias("fp")).alias("label"))


def near_duplicates(docs: DataFrame, radius: int = 4, blocks: int = 6, shard_size: int = 2000) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    ``component_id`` is the smallest doc_id that links reach. Null and empty texts
    have fingerprint zero and link like any other; rows without doc_id neither
    name nor join a group other than by their fingerprint, and get the smallest
    doc_id there (null if there is none); equal rows give equal rows; an empty
    table gives none; other columns are ignored.
    """
    prints, owner = grouped(docs, radius, blocks, shard_size)
    return looked_up(prints.drop("check"), owner, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("label.id").alias("component_id"))


def deduplicated(docs: DataFrame, radius: int = 8, blocks: int = 10, shard_size: int = 2000, shingle: int = 2, check_radius: int = 12) -> DataFrame:
    """The documents, with all their columns, of which one of each group stays.

    Two are linked if their fingerprints over runs of ``shingle`` words are within ``radius``
    and second ones, over the same runs, within ``check_radius``.

    The smallest doc_id of a group stays. Where a doc_id names several rows, they are
    told apart by their fingerprints: rows that share a doc_id but no group lose
    nothing, and of equal or near-equal rows of one doc_id one stays (the smallest
    fingerprint; any of those that share that). Rows without doc_id cannot be named as
    copies and stay. Null and empty texts are copies of each other; an empty table
    gives none.
    """
    prints, owner = grouped(docs, radius, blocks, shard_size, shingle, check_radius)
    rows = prints.where("doc_id is not null").groupBy("doc_id", "fp").agg(F.count("*").alias("n"))
    rows = materialise(looked_up(materialise(rows, "simhash-named-rows"), owner, "fp").select("doc_id", "fp", "n", (F.col("label.id") == F.col("doc_id")).alias("own"), (F.col("label.fp") == F.col("fp")).alias("first")), "simhash-rows")
    if rows.groupBy("doc_id").agg(F.sum("n").alias("n")).where("n > 1").isEmpty():
        dropped = rows.where("not own").select("doc_id")
        dropped = dropped.hint("merge") if dropped.count() > FEW else dropped  # few may be broadcast, so that texts stay where they lie
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    column = "simhash of the text"
    while column in docs.columns:  # a name that no column has
        column += "_"
    names, text = [*docs.columns, column], docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(column, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in batch.column(text).cast(pa.binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=names)

    known = materialise(docs.mapInArrow(run, schema), "simhash-named")
    kept = rows.where("own and first").select("doc_id", F.col("fp").alias(column))
    named = known.where("doc_id is not null").join(kept.hint("merge"), ["doc_id", column], "left_semi").dropDuplicates(["doc_id", column])
    return named.unionByName(known.where("doc_id is null")).select(*docs.columns)
