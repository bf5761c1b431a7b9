"""A vector index that is written once and searched many times.

Rows (id, vector) of length 1 go to the cell of their nearest centroid; what a centroid leaves
is cut into parts, and each part is known by the nearest of its codebook's entries: a
byte a part. Centroids and codebooks are fitted by k-means on a bounded sample of rows
(``sample``, those of the smallest id hashes); every row is indexed. Codes lie sorted by
cell, a hot cell in many files, with the whole vectors as a column that is read only where it is needed.

A search takes a stated query set in blocks, whose hits are written one after another. A block's tables of products between its parts and all
entries are broadcast (their size is bounded); tasks read the cells that some query probes,
add up a product a part and keep the best rows a query, which are then scored exactly.
For a unit query the product misses the cosine by no more than the length of what the code leaves out,
which is stored, and a cell holds nothing above its centroid's product plus its radius:
an exact search then scores the rows whose bound reaches the k-th score found, in all cells
whose bound does, in the task that reads them, and so gives the answer of a full scan. However many
rows these are, k of them a query leave a task. Without that step it is as good as its
recall, which ``recall`` measures: the number of cells to probe is the least by which ``aim`` of the
sample's own nearest neighbours are reached, found when the index is built.

Rows of another dimension than most, and rows without a vector, are left out; zero vectors have cosine 0.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.vectors import HELD, SEARCHED, _best, _blocks, _fitting, _unit, lowest
from larkspur.shared import materialise

CODES = "id long, cell int, code binary, error float"
VECTOR = "vector array<float>"
CELLS = "cell int, n long, radius double"
GROUP = 1 << 20
#: Slack of bounds, as products are sums of rounded numbers.
SLACK = 1e-6


def k_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres of rows, beginning with rows spread over them; centres without a row take the farthest ones."""
    centres = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        near, far = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if len(empty := np.flatnonzero(counts == 0)):
            centres[empty] = rows[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and its squared distance."""
    lengths = (centres**2).sum(axis=1)
    near, far = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    step = min(8192, max(1, 4 * HELD // len(centres)))
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        d = lengths - 2 * some @ centres.T
        near[at : at + step] = d.argmin(axis=1)
        far[at : at + step] = d.min(axis=1) + (some**2).sum(axis=1)
    return near, far


def enough_probes(rows: np.ndarray, centroids: np.ndarray, aim: float, queries: int = 500, k: int = 10) -> int:
    """The least number of probes that reach the share ``aim`` of some rows' k nearest others."""
    some = np.linspace(0, len(rows) - 1, min(queries, len(rows))).astype(int)
    near, step = np.zeros((len(some), min(k, len(rows) - 1)), np.int64), max(1, HELD // len(rows))
    for at in range(0, len(some), step):
        scores = rows[some[at : at + step]] @ rows.T
        scores[np.arange(len(scores)), some[at : at + step]] = -np.inf
        near[at : at + step] = np.argsort(-scores, axis=1, kind="stable")[:, : near.shape[1]]
    cell = nearest(rows, centroids)[0]
    order = np.argsort(-(rows[some] @ centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each cell in a query's order
    steps = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(steps[min(int(aim * len(steps)), len(steps) - 1)]) + 1 if len(steps) else 1


class VectorIndex:
    """An index below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        held = np.load(io.BytesIO(bytes(spark.read.parquet(f"{self.path}/model").first()["model"])))
        self.centroids, self.books, self.probes = held["centroids"], held["books"], int(held["probes"])
        rows = spark.read.schema(CELLS).parquet(f"{self.path}/cells").collect()
        self.radius, self.sizes = np.full(len(self.centroids), -np.inf), np.zeros(len(self.centroids), np.int64)
        for r in rows:
            self.radius[r["cell"]], self.sizes[r["cell"]] = r["radius"], r["n"]

    @property
    def dimensions(self) -> int:
        return self.centroids.shape[1]

    @property
    def code_bytes(self) -> int:
        """Bytes of a code; a vector of single precision has four a dimension."""
        return len(self.books)

    @classmethod
    def build(cls, corpus: DataFrame, path: str, cells: int | None = None, parts: int = 16, entries: int = 256, sample: int = 20_000, aim: float = 0.97) -> VectorIndex:
        """Indexes all rows of ``corpus`` (id, vector); the number of cells is about the root of theirs, at most 4096."""
        spark = corpus.sparkSession
        rows = corpus.where("vector is not null").select(F.col("id").cast("long").alias("id"), "vector")
        kinds = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        wide, n = (kinds["d"], kinds["n"]) if kinds else (1, 0)
        fitted = lowest(rows.where(F.size("vector") == wide), F.xxhash64("id"), sample)
        known = _unit(np.array([r["vector"] for r in fitted], np.float64).reshape(-1, wide)) if fitted else np.zeros((1, wide))
        centroids = k_means(known, cells or min(4096, max(1, int(n**0.5))))
        left = cls._parts(known - centroids[nearest(known, centroids)[0]], parts)
        books = np.stack([np.pad(b := k_means(left[p], min(entries, 256)), ((0, min(entries, 256) - len(b)), (0, 0)), mode="edge") for p in range(parts)])
        held = io.BytesIO()
        np.savez(held, centroids=centroids, books=books, probes=enough_probes(known, centroids, aim))
        spark.createDataFrame([(bytearray(held.getvalue()),)], "model binary").coalesce(1).write.parquet(f"{path}/model")
        sent = spark.sparkContext.broadcast((centroids, books))

        def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, books = sent.value
            for batch in batches:
                ids, m = _fitting(batch, centroids.shape[1])
                cell = nearest(m, centroids)[0]
                rest = m - centroids[cell]
                codes = np.zeros((len(ids), len(books)), np.uint8)
                missed = np.zeros(len(ids))
                for p, part in enumerate(cls._parts(rest, len(books))):
                    near, far = nearest(part, books[p])
                    codes[:, p] = near
                    missed += np.maximum(far, 0)
                raw, size = codes.tobytes(), len(books)
                fits = np.flatnonzero(batch.column("vector").value_lengths().to_numpy(zero_copy_only=False) == centroids.shape[1])
                columns = [pa.array(ids, pa.int64()), pa.array(cell, pa.int32()), pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary()), pa.array(np.nextafter(np.sqrt(missed).astype(np.float32), np.float32(9))), batch.column("vector").take(pa.array(fits)).cast(pa.list_(pa.float32())), pa.array(np.sqrt((rest**2).sum(axis=1)), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cell", "code", "error", "vector", "reach"])

        coded = materialise(rows.mapInArrow(encoded, f"{CODES}, {VECTOR}, reach double"), "vector-codes")
        names = [c.split()[0] for c in f"{CODES}, {VECTOR}".split(", ")]
        coded.select(*names).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.option("parquet.block.size", GROUP).parquet(f"{path}/codes")
        coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius")).coalesce(1).write.parquet(f"{path}/cells")
        return cls(spark, path)

    @staticmethod
    def _parts(rows: np.ndarray, parts: int) -> np.ndarray:
        """Rows as (part, row, dimension), filled up with zeros."""
        wide = -(-rows.shape[1] // parts)
        return np.pad(rows, ((0, 0), (0, wide * parts - rows.shape[1]))).reshape(len(rows), parts, wide).transpose(1, 0, 2)

    def _read(self, schema: str, cells: np.ndarray) -> DataFrame:
        """Columns of the rows of some cells."""
        codes = self.spark.read.schema(f"{CODES}, {VECTOR}").parquet(f"{self.path}/codes")
        return codes.where(F.col("cell").isin(np.flatnonzero(cells).tolist())).select(*[c.split()[0] for c in schema.split(", ")])

    def _found(self, names: np.ndarray, q: np.ndarray, probed: np.ndarray, keep: int, floor: np.ndarray | None = None) -> DataFrame:
        """(query_id, id, score): of each query the best ``keep`` rows of the cells that it probes.

        By the products of codes, or, given each query's ``floor``, by rounded cosines of the rows whose bound reaches it.
        ``probed`` has a row a query and a column a cell.
        """
        centroids, books = self.centroids, self.books
        tables = np.einsum("pqd,ped->qpe", self._parts(q, len(books)), books)
        sent = self.spark.sparkContext.broadcast((names, q, q @ centroids.T, tables, probed, floor))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, centre, tables, probed, floor = sent.value
            held = [(np.empty(0, np.int64), np.empty(0)) for _ in names]
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, cell, error = (np.asarray(batch.column(c)) for c in ("id", "cell", "error"))
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                whole = None if floor is None else _fitting(batch, q.shape[1])[1]
                for i in range(len(names)):
                    at = np.flatnonzero(probed[i, cell])
                    if not len(at):
                        continue
                    score = centre[i, cell[at]] + tables[i, np.arange(codes.shape[1]), codes[at]].sum(axis=1)
                    if whole is not None:
                        at = at[score + error[at] >= floor[i] - SLACK]
                        score = np.round((whole[at] * q[i]).sum(axis=1), 9)
                    own, found = np.append(held[i][0], ids[at]), np.append(held[i][1], score)
                    best = _best(found, own, keep)
                    held[i] = own[best], found[best]
            columns = [np.repeat(names, [len(i) for i, _ in held]), *(np.concatenate(c) for c in zip(*held, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "score"])

        found = self._read(CODES if floor is None else f"{CODES}, {VECTOR}", probed.any(axis=0)).mapInArrow(run, SEARCHED)
        return _ranked(found, keep)

    def _exact(self, names: np.ndarray, q: np.ndarray, pairs: DataFrame) -> DataFrame:
        """Rounded cosines of a block's pairs (query_id, id), which are broadcast."""
        sent = self.spark.sparkContext.broadcast((names, q))
        vectors = self.spark.read.schema(f"id long, {VECTOR}").parquet(f"{self.path}/codes")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            order = np.argsort(names)
            for batch in batches:
                ids, m = _fitting(batch, q.shape[1])
                asked = np.asarray(batch.column("query_id"))
                own = q[order[np.searchsorted(names[order], asked)]]
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(ids), pa.array(np.round((m * own).sum(axis=1), 9))], names=["query_id", "id", "score"])

        return vectors.join(F.broadcast(pairs), "id").select("query_id", "id", "vector").mapInArrow(run, SEARCHED)

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, oversample: int = 10, exact: bool = False, block: int = 256) -> DataFrame:
        """The k rows most alike to each of ``queries`` (query_id, query_vector), ranked by rounded cosine, then id.

        ``probes`` cells are read a query (the index's own number unless given), and ``k * oversample`` rows scored exactly. With ``exact``
        the answer is that of a full scan; a query's bound reads further cells only where they may hold a hit.
        """
        parts = []
        for names, matrix in _blocks(queries.where(F.size("query_vector") == self.dimensions), block):
            q = _unit(matrix)
            order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, : probes or self.probes]
            probed = np.zeros((len(q), len(self.centroids)), bool)
            np.put_along_axis(probed, order, True, axis=1)
            near = materialise(self._found(names, q, probed, k * oversample).select("query_id", "id"), "vector-near")
            hits = materialise(_ranked(self._exact(names, q, near), k), "vector-hits")
            if exact:
                floors = dict(hits.where(F.col("rank") == k).select("query_id", "score").collect())  # a row a query of the block
                floor = np.array([floors.get(i, -np.inf) for i in names.tolist()])
                reach = (q @ self.centroids.T + self.radius >= floor[:, None] - SLACK) & (self.sizes > 0)
                hits = materialise(self._found(names, q, reach, k, floor), "vector-hits")
            parts.append(hits)
        if not parts:
            return self.spark.createDataFrame([], f"{SEARCHED}, rank int")
        return _ranked(reduce(DataFrame.unionAll, parts).drop("rank"), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their ``rank``, by score and id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): the share of a query's true hits (query_id, id) that were found."""
    got = found.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    return truth.join(got, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
