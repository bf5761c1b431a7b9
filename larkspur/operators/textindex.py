"""A text index that is written once, searched many times and kept up by changes.

Documents (id, text) lie in segments. A segment has a forward table, a row a document
with its content hash, length and terms, and postings. A task that reads forward rows deals them to chunks
of at most ``DOCS`` documents, in the order of their lengths, and writes a row a term and chunk with the places of the
documents that hold it; the row of the empty term has the ids and lengths of the places. So neither texts nor
postings are shuffled to write them. A chunk's rows are sorted by term in small row groups, and a search
reads those of its terms only.

A search brings each chunk's rows of asked terms together. About ``block`` documents that follow each other
are a range, whose bound is the sum of its terms' largest weights. The ranges of the highest bounds are scored, then
those others that reach the k-th score that the task has found; a task gives its best k a query. Results are
those of scoring all documents.

Changes make a new segment of inserted and edited documents, a list of dead ones and
what their terms take from document frequencies, all in folders of their own; a new
version names them and the alias is swapped (see versions). Null texts are empty; of rows that
share an id the one with the greatest text counts; rows without an id are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from larkspur.functions.text import tokens
from larkspur.operators.lexical import SELF, asked_terms, blocks, ranked
from larkspur.operators.vectors import _best
from larkspur.operators.versions import Versions
from larkspur.shared import materialise, spread

FORWARD = "id long, hash string, length int, terms array<struct<term:string,tf:int>>"
POSTINGS = "term string, chunk long, n int, ids array<long>, lengths array<int>, places array<short>, tf array<int>"
DEAD = "segment string, chunk long, id long"
MINUS = "term string, n long"
#: Bytes of a row group, so that the statistics of terms leave most of a file out.
GROUP = 1 << 20
#: Documents and postings of a chunk (a document is whole); places are 16-bit numbers.
DOCS, POSTS = 4096, 1 << 20
#: Distinct terms up to which a search filters the scan by their list.
PUSHED = 5000
#: Weights that a task holds at once.
HELD = 1 << 22


def single(docs: DataFrame) -> DataFrame:
    """(id, text), one row an id. Only texts of ids that several rows share are shuffled."""
    rows = docs.where("id is not null").select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    repeated = materialise(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "index-repeated")
    rows = spread(rows)
    if repeated.isEmpty():
        return rows
    others = rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    return rows.join(repeated, "id", "left_anti").unionByName(others)


def forward(docs: DataFrame) -> DataFrame:
    """Documents with their terms, counted where the text lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("all")
            length = every.value_lengths().to_numpy(zero_copy_only=False)
            words = every.flatten().dictionary_encode()
            code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            wide = max(len(words.dictionary), 1)
            cell, tf = np.unique(np.repeat(np.arange(len(length)), length) * wide + code, return_counts=True)
            ends = np.searchsorted(cell, np.arange(len(length) + 1) * wide).astype(np.int32)
            terms = pa.StructArray.from_arrays([words.dictionary.take(pa.array(cell % wide)), pa.array(tf.astype(np.int32))], names=["term", "tf"])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), pa.array(length.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), terms)], names=["id", "hash", "length", "terms"])

    return single(docs).select("id", F.md5("text").alias("hash"), tokens(F.col("text")).alias("all")).mapInArrow(run, FORWARD)


def postings(rows: DataFrame) -> DataFrame:
    """Postings of forward rows, chunk by chunk within their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            held = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            at, upto = 0, np.concatenate([[0], np.cumsum(held)])
            while at < batch.num_rows:
                most = int(np.searchsorted(upto, upto[at] + POSTS, "right")) - 1 - at
                some = batch.slice(at, min(DOCS, max(most, 1)))
                at += some.num_rows
                yield chunk(number, some.take(pc.sort_indices(some, [("length", "ascending"), ("id", "ascending")])))
                number += 1

    def chunk(number: int, docs: pa.RecordBatch) -> pa.RecordBatch:
        terms = docs.column("terms").flatten()
        words = terms.field("term").dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False)
        names = words.dictionary.take(pc.sort_indices(words.dictionary))
        rank = pc.index_in(words.dictionary, names).to_numpy(zero_copy_only=False)[code]
        order = np.argsort(rank, kind="stable")
        place = np.repeat(np.arange(docs.num_rows), docs.column("terms").value_lengths().to_numpy(zero_copy_only=False)).astype(np.int16)[order]
        n = np.bincount(rank, minlength=len(names))
        ends = np.concatenate([[0, 0], np.cumsum(n)]).astype(np.int32)
        whole = pa.array(np.concatenate([[0], np.full(len(names) + 1, docs.num_rows)]).astype(np.int32))
        columns = [
            pa.concat_arrays([pa.array([SELF], names.type), names]), pa.array(np.full(len(names) + 1, number, np.int64)), pa.array(np.concatenate([[docs.num_rows], n]).astype(np.int32)),
            pa.ListArray.from_arrays(whole, docs.column("id")), pa.ListArray.from_arrays(whole, docs.column("length")),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(place)), pa.ListArray.from_arrays(pa.array(ends), terms.field("tf").take(pa.array(order))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in POSTINGS.split(", ")])

    return rows.select("id", "length", "terms").mapInArrow(run, POSTINGS)


class TextIndex:
    """An index below ``path``; ``block`` is the number of documents a range aims at."""

    def __init__(self, spark: SparkSession, path: str, block: int = 16, segments: int = 8):
        self.spark, self.path, self.block, self.most = spark, path.rstrip("/"), block, segments
        self.versions = Versions(spark, path)

    def version(self) -> dict:
        found = self.versions.current()
        return found[1] if found else {"segments": [], "dead": [], "minus": [], "n": 0, "length": 0}

    def _read(self, kind: str, names: list[str], schema: str, **columns: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{kind}").withColumns({c: F.lit(name) for c in columns}) for name in names]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], ", ".join([schema, *(f"{c} string" for c in columns)]))

    def live(self, version: dict | None = None) -> DataFrame:
        """(id, hash, length, terms, segment) of the documents of a version."""
        version = version or self.version()
        return self._live(self._read("forward", version["segments"], FORWARD, segment=""), version)

    def _live(self, rows: DataFrame, version: dict) -> DataFrame:
        return rows.join(self._read("dead", version["dead"], DEAD), ["segment", "id"], "left_anti") if version["dead"] else rows

    def _write_postings(self, name: str) -> tuple[int, int]:
        """Postings of a written forward table; the number of its documents and their total length."""
        rows = self.spark.read.schema(FORWARD).parquet(f"{self.path}/{name}/forward")
        postings(rows).write.option("parquet.block.size", GROUP).option("compression", "zstd").parquet(f"{self.path}/{name}/postings")
        return tuple(rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first())

    def _publish(self, version: dict, seen: int) -> int:
        """Adds a version and uses it, unless another writer has swapped the alias since ``seen``."""
        number = self.versions.add(version)
        self.versions.use(number, seen)
        return number

    def changes(self, docs: DataFrame) -> DataFrame:
        """(id, op) that lead from the version in use to ``docs`` (id, text): insert, edit or delete."""
        new = single(docs).select("id", F.md5("text").alias("new"))
        both = self.live().select("id", "hash").join(new, "id", "full_outer")
        op = F.when(F.col("hash").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("hash") != F.col("new"), "edit")
        return both.select("id", op.alias("op")).where("op is not null")

    def refresh(self, docs: DataFrame) -> int:
        """Makes the index that of ``docs``, touching changed documents only; the number of the version."""
        changed = materialise(self.changes(docs), "index-changes")
        return self.apply(docs.join(changed.where("op <> 'delete'").select("id"), "id", "left_semi"), changed.where("op = 'delete'").select("id"))

    def apply(self, upserts: DataFrame, deletes: DataFrame | None = None) -> int:
        """Adds or replaces ``upserts`` (id, text) and removes ``deletes`` (id); the number of the version."""
        seen, version, name = self.versions.last(), self.version(), f"segments/{uuid.uuid4().hex}"
        forward(upserts).write.option("compression", "zstd").parquet(f"{self.path}/{name}/forward")
        n, length = self._write_postings(name)
        gone = self.spark.read.schema(FORWARD).parquet(f"{self.path}/{name}/forward").select("id")
        if deletes is not None:
            gone = gone.unionByName(deletes.select(F.col("id").cast("long").alias("id"))).distinct()
        if version["segments"]:
            gone = materialise(gone, "index-gone")
            places = self._read("postings", version["segments"], POSTINGS, segment="").where(F.col("term") == SELF)
            places = places.select("segment", "chunk", F.explode(F.arrays_zip("ids", "lengths")).alias("d")).select("segment", "chunk", F.col("d.ids").alias("id"), F.col("d.lengths").alias("length"))
            old = materialise(self._live(places.join(gone, "id", "left_semi"), version), "index-dead")
            old.select("segment", "chunk", "id").write.parquet(f"{self.path}/{name}/dead")
            terms = self.live(version).select("id", F.col("terms.term").alias("terms")).join(gone, "id", "left_semi")
            terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).write.parquet(f"{self.path}/{name}/minus")
            lost = old.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            n, length = n - lost[0], length - lost[1]
            version = version | {"dead": [*version["dead"], name], "minus": [*version["minus"], name]}
        number = self._publish(version | {"segments": [*version["segments"], name], "n": version["n"] + n, "length": version["length"] + length}, seen)
        return self.merge() if len(version["segments"]) >= self.most else number

    def merge(self) -> int:
        """Rewrites all live documents as one segment, from their forward rows."""
        seen, version, name = self.versions.last(), self.version(), f"segments/{uuid.uuid4().hex}"
        self.live(version).select(*(c.split()[0] for c in FORWARD.split(", "))).write.option("compression", "zstd").parquet(f"{self.path}/{name}/forward")
        n, length = self._write_postings(name)
        return self._publish({"segments": [name], "dead": [], "minus": [], "n": n, "length": length}, seen)

    def rollback(self, number: int) -> None:
        """Uses an earlier version again."""
        self.versions.use(number)

    # Search

    def _searched(self, queries: DataFrame, k: int, first: int, counted: bool = False) -> DataFrame:
        """(query_id, id, score) of each task's best k, or (query_id, n_postings, n_scored) of each chunk."""
        version = self.version()
        rows = reduce(DataFrame.unionByName, [self._read("postings", [name], POSTINGS).withColumn("segment", F.lit(i)) for i, name in enumerate(version["segments"])] or [self._read("postings", [], POSTINGS).withColumn("segment", F.lit(0))])
        wanted = asked_terms(queries).select("term").distinct()
        some = [r[0] for r in wanted.limit(PUSHED + 1).collect()]
        own = rows.where(F.col("term").isin(some)) if len(some) <= PUSHED else rows.join(wanted, "term", "left_semi")
        count = own.select("term", "n").unionByName(self._read("minus", version["minus"], MINUS).join(wanted, "term", "left_semi").select("term", (-F.col("n")).alias("n")))
        df = materialise(count.groupBy("term").agg(F.sum("n").alias("df")), "index-frequencies")
        dead = self._read("dead", version["dead"], DEAD)
        segments = F.array_position(F.lit(version["segments"]), F.col("segment")) - 1 if version["segments"] else F.lit(0)
        dead = dead.select(segments.cast("int").alias("segment"), "chunk", F.array("id").alias("ids"))
        asked = queries.schema["query_id"].dataType
        schema = f"query_id {asked.simpleString()}, " + ("n_postings long, n_scored long" if counted else "id long, score double")
        mean = version["length"] / version["n"] if version["n"] else 1.0
        parts = []
        for block in blocks(float(version["n"]), df, queries):
            sent = self.spark.sparkContext.broadcast(block)
            near = rows.where(F.col("term").isin([SELF, *block[3]])) if len(block[3]) <= PUSHED else rows.join(F.broadcast(self.spark.createDataFrame([(t,) for t in (SELF, *block[3])], "term string")), "term", "left_semi")
            near = near.select("segment", "chunk", "term", "ids", "lengths", "places", "tf")
            whole = near.unionByName(dead, allowMissingColumns=True).repartition("segment", "chunk").sortWithinPartitions("segment", "chunk")
            parts.append(whole.mapInArrow(_scorer(sent, k, first, mean, self.block, counted, to_arrow_type(asked)), schema))
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], schema)

    def search(self, queries: DataFrame, k: int = 3, first: int = 8, places: int = 4) -> DataFrame:
        """The best k documents of each query (query_id, query), ranked from 1; ties go to the smaller id."""
        return ranked(self._searched(queries, k, first), k, places)

    def work(self, queries: DataFrame, k: int = 3, first: int = 8) -> DataFrame:
        """(query_id, n_postings, n_scored) of each query that holds a term of the index."""
        return self._searched(queries, k, first, counted=True).groupBy("query_id").agg(F.sum("n_postings").alias("n_postings"), F.sum("n_scored").alias("n_scored"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Chunks, each with all its rows."""
    left = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if left is None else pa.concat_tables([left, rows])
        if not rows.num_rows:
            continue
        segment, chunk = (rows.column(c).to_numpy() for c in ("segment", "chunk"))
        cuts = np.flatnonzero((segment[1:] != segment[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        at = 0
        for cut in cuts.tolist():
            yield rows.slice(at, cut - at)
            at = cut
        left = rows.slice(at)
    if left is not None:
        yield left


def _scorer(sent, k: int, first: int, mean: float, block: int, counted: bool, kind: pa.DataType, k1: float = 1.2, b: float = 0.75):
    """Scores whole chunks for a block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, starts, asked, terms, idf = sent.value
        known, ends = pa.array(terms, pa.string()), [*starts[1:].tolist(), len(asked)]
        best = [(np.empty(0, np.int64), np.empty(0)) for _ in queries]  # this task's so far
        floor = np.full(len(queries), -np.inf)
        n_all, n_scored = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)

        def score(q: int, own: np.ndarray, weight: np.ndarray, ids: np.ndarray, ranges: np.ndarray) -> None:
            columns = (ranges[:, None] * block + np.arange(block)).ravel()
            part = weight[own][:, columns]
            n_scored[q] += np.count_nonzero(part) if counted else 0
            found = part.sum(axis=0)
            hit = np.flatnonzero((found > 0) & (np.round(found, 9) >= floor[q]))
            if len(hit):
                named, values = np.append(best[q][0], ids[columns[hit]]), np.append(best[q][1], found[hit])
                keep = _best(np.round(values, 9), named, k)
                best[q] = named[keep], values[keep]
                if len(keep) == k:
                    floor[q] = np.round(values[keep[-1]], 9)

        for rows in _whole(batches):
            term = rows.column("term").combine_chunks()
            held = pc.equal(term, SELF)
            if not pc.any(held).as_py():
                continue  # none of the documents of dead rows is left in this chunk
            doc = rows.filter(held)
            ids, length = (doc.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "lengths"))
            dead = rows.filter(pc.is_null(term)).column("ids").combine_chunks().flatten().to_numpy()
            live = ~np.isin(ids, dead)
            code = pc.fill_null(pc.index_in(term, known), -1).to_numpy(zero_copy_only=False)
            mine = np.flatnonzero(code >= 0)
            if not len(mine):
                continue
            lists = rows.take(pa.array(mine))
            places, tf = (lists.column(c).combine_chunks() for c in ("places", "tf"))
            row = np.repeat(np.arange(len(mine)), places.value_lengths().to_numpy(zero_copy_only=False))
            places, tf = places.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.float64)
            value = idf[code[mine]][row] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[places] / (mean or 1))) * live[places]
            where = np.full(len(terms), len(mine))  # absent terms are the last row, of zeros
            where[code[mine]] = np.arange(len(mine))
            own = where[asked]
            by_place = np.argsort(places, kind="stable")
            row, places, value = row[by_place], places[by_place], value[by_place]
            step = max(1, HELD // max(len(asked), len(mine) + 1) // block) * block
            for at in range(0, len(ids), step):
                some = slice(*np.searchsorted(places, [at, at + step]).tolist())
                docs = ids[at : at + step]
                wide = -(-len(docs) // block)
                weight = np.zeros((len(mine) + 1, wide * block))
                weight[row[some], places[some] - at] = value[some]
                bound = np.add.reduceat(weight.reshape(len(weight), wide, block).max(axis=2)[own], starts, axis=0)
                if counted:
                    n_all += np.add.reduceat(np.count_nonzero(weight, axis=1)[own], starts)
                for q in np.flatnonzero((bound.max(axis=1) > 0) & (bound.max(axis=1) >= floor - 1e-8)).tolist():
                    used = own[starts[q] : ends[q]]
                    used = used[used < len(mine)]
                    order = np.argsort(-bound[q], kind="stable")
                    for ranges in (order[:first], order[first:]):
                        # scores are ranked by nine places
                        ranges = ranges[(bound[q, ranges] > 0) & (bound[q, ranges] >= floor[q] - 1e-8)]
                        if len(ranges):
                            score(q, used, weight, docs, ranges)
        if counted:
            some = np.flatnonzero(n_all)
            yield pa.RecordBatch.from_arrays([pa.array([queries[q] for q in some]).cast(kind), pa.array(n_all[some]), pa.array(n_scored[some])], names=["query_id", "n_postings", "n_scored"])
        else:
            columns = [pa.array([n for n, (i, _) in zip(queries, best, strict=True) for _ in i]).cast(kind), *(pa.array(np.concatenate(c)) for c in zip(*best, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score"])

    return run
