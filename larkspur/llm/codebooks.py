"""Product quantisation of vectors: codebooks by RDD treeAggregate over columnar blocks.

Vectors become integers, floor(256 * x), and are cut into equal consecutive parts, each
with a codebook of its own. A batch of vectors is one row of a written table: its
components dimension by dimension, so that a task holds a block as NumPy columns. A round
assigns the parts of every block to their nearest entries, the squared differences adding
up dimension by dimension, and gathers int64 sums and counts for each entry with
np.add.at; the tensors of tasks, of one size whatever the input, meet in the tree of
treeAggregate. All arithmetic is on integers, so codes, errors and codebooks do not
depend on how the rows lie.

Null, NaN and infinite components drop a vector, as does a null array. A vector shorter
than the longest counts as filled up with zeros, and so does the longest up to a multiple
of the number of parts; an empty vector is all zeros. Repeated rows are rows of their own. Rows
of one vec_id are ordered by their components, null ids come last. With fewer rows than entries
each row is an entry. Integers beyond ``bound_of`` (2^27 for 64 components) are taken as
that bound, so that no distance overflows. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.shared import materialise

#: Rows that are compared with a codebook at once.
ROWS = 4096
#: Tasks whose tensors meet in one at each level of the tree.
FAN_IN = 16


def bound_of(length: int) -> int:
    """Largest integer of a component: squared distances of whole vectors stay below 2^62."""
    return 1 << (62 - max(1, length).bit_length()) // 2 - 1


def kept(vectors: DataFrame) -> DataFrame:
    """The rows to encode: vec_id, label and components as doubles."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & good)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("embedding"))


def integers(lists: pa.Array, length: int) -> np.ndarray:
    """Components of a batch as integers, one row of the result a dimension."""
    flat = np.floor(256 * np.asarray(lists.flatten(), np.float64))
    limit = bound_of(length)
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    out = np.zeros((len(sizes), length), np.int64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(starts, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), place] = np.clip(flat, -limit, limit)
    return np.ascontiguousarray(out.T)


def blocks(rows: DataFrame, length: int) -> DataFrame:
    """One row a batch of vectors: its components as columns, in the narrowest integers, beside ids and labels."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data = integers(batch.column("embedding"), length)
            top = int(np.abs(data).max(initial=0))
            kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if top < 1 << 8 * int(k[-1]) - 1)
            one = pa.array([0, batch.num_rows], pa.int32())
            ids, labels = (pa.ListArray.from_arrays(one, batch.column(c)) for c in ("vec_id", "label"))
            columns = [pa.array([kind]), pa.array([batch.num_rows]), pa.array([data.astype(kind).tobytes()]), ids, labels]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "n", "data", "ids", "labels"])

    return rows.mapInArrow(run, f"kind string, n long, data binary, ids array<long>, labels array<{label}>")


def unpacked(kind: str, n: int, data: bytes, parts: int) -> np.ndarray:
    """A block as (part, dimension, vector)."""
    return np.frombuffer(data, kind).reshape(parts, len(data) // int(kind[-1]) // (parts * n), n)


def nearest(columns: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each vector, the first of equal ones, and its squared distance.

    ``columns`` has a row a dimension, ``entries`` a row an entry.
    """
    n = columns.shape[1]
    codes, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for at in range(0, n, ROWS):
        some = columns[:, at : at + ROWS].astype(np.int64)
        far = np.zeros((some.shape[1], len(entries)), np.int64)
        for dimension, column in enumerate(some):
            step = column[:, None] - entries[None, :, dimension]
            far += step * step
        best = far.argmin(axis=1)
        codes[at : at + ROWS], least[at : at + ROWS] = best, far[np.arange(len(best)), best]
    return codes, least


@dataclass
class Tensor:
    """Sums and counts of the parts that each entry has drawn."""

    sums: np.ndarray
    counts: np.ndarray

    def add(self, block: np.ndarray, books: np.ndarray) -> Tensor:
        for part, columns in enumerate(block):
            codes, _ = nearest(columns, books[part])
            np.add.at(self.counts[part], codes, 1)
            np.add.at(self.sums[part], codes, columns.T.astype(np.int64))
        return self

    def merge(self, other: Tensor) -> Tensor:
        self.sums += other.sums
        self.counts += other.counts
        return self


def round_of(data: RDD, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round; unused entries stay."""
    shared = data.context.broadcast(books)
    parts, entries, width = books.shape
    zero = Tensor(np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64))
    depth, tasks = 2, data.getNumPartitions()
    while FAN_IN**depth < tasks:
        depth += 1
    got = data.treeAggregate(zero, lambda t, row: t.add(unpacked(row["kind"], row["n"], row["data"], parts), shared.value), Tensor.merge, depth)
    shared.unpersist()
    used = got.counts > 0
    return np.where(used[:, :, None], got.sums // np.maximum(got.counts, 1)[:, :, None], books)


@dataclass
class Codebooks:
    """Entries as (part, entry, dimension), for vectors of ``length`` components."""

    entries: np.ndarray
    length: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for, as real numbers."""
        picked = [self.entries[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(self.entries))]
        return (np.concatenate(picked)[: self.length] + 0.5) / 256


def first_entries(rows: DataFrame, length: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the rows with the smallest ids."""
    whole = F.transform("embedding", lambda x: F.floor(x * 256).cast("double"))
    first = rows.withColumn("whole", whole).orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("embedding").collect()
    data = integers(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), length)
    return np.ascontiguousarray(data.reshape(parts, length // parts, len(first)).transpose(0, 2, 1))


def fit(rows: DataFrame, data: DataFrame, length: int, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks:
    """Codebooks of kept rows and their written blocks; at most 256 entries, as a code has two hex digits."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    books = first_entries(rows, length, parts, entries)
    columns = data.select("kind", "n", "data").rdd
    for _ in range(rounds):
        books = round_of(columns, books)
    return Codebooks(books, length)


def codes(data: DataFrame, books: Codebooks) -> DataFrame:
    """Code and error of every vector of the blocks."""
    shared = data.sparkSession.sparkContext.broadcast(books.entries)
    label = data.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                block = unpacked(*(batch.column(c)[at].as_py() for c in ("kind", "n", "data")), len(entries))
                found = [nearest(columns, entries[p]) for p, columns in enumerate(block)]
                code = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                text = code.tobytes().hex()
                wide = 2 * len(entries)
                ids, labels = batch.column("ids")[at].values, batch.column("labels")[at].values
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[i : i + wide] for i in range(0, len(text), wide)]), pa.array(sum(e for _, e in found))], names=["vec_id", "label", "code", "error"])

    return data.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Codes of all vectors with the errors of their labels; see the module on odd rows."""
    spark = vectors.sparkSession
    rows = kept(vectors)
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    length = -(-longest // parts) * parts
    data = materialise(blocks(rows, length), "vector-blocks")
    books = fit(rows, data, length, parts, entries, rounds)
    coded = materialise(codes(data, books), "vector-codes")
    # sums of labels meet the rows of theirs in a join that adaptive execution may split
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The same in SQL, for vectors of one length that ``parts`` divides."""
    steps = [
        "W AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        "R AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, * FROM W)",
        f"P AS (SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS s FROM R, (SELECT unnest(range({parts})) AS p))",
        f"B0 AS (SELECT p, r - 1 AS e, s FROM P WHERE r <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"D{k} AS (SELECT P.r, P.p, B{k}.e, list_sum(list_transform(list_zip(P.s, B{k}.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM P JOIN B{k} USING (p))")
        steps.append(f"A{k} AS (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM D{k} GROUP BY r, p)")
        if k < rounds:
            steps.append(f"U{k} AS (SELECT p, e, j, sum(x)::BIGINT AS t, count(*) AS c FROM (SELECT p, e, unnest(s) AS x, generate_subscripts(s, 1) AS j FROM A{k} JOIN P USING (r, p)) GROUP BY p, e, j)")
            steps.append(f"M{k} AS (SELECT p, e, list((t - ((t % c) + c) % c) // c ORDER BY j) AS s FROM U{k} GROUP BY p, e)")
            steps.append(f"B{k + 1} AS (SELECT p, e, coalesce(M{k}.s, B{k}.s) AS s FROM B{k} LEFT JOIN M{k} USING (p, e))")
    steps += [
        f"C AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM A{rounds} GROUP BY r)",
        f"H AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM (SELECT p, e, unnest(s) AS x, generate_subscripts(s, 1) AS j FROM B{rounds}))",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM C JOIN R USING (r), H"


SQL = _sql()
