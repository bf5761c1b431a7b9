"""Late interaction: documents and queries are sets of token vectors.

The score of a document is the sum, over the tokens of the query, of the largest cosine with any of its
own. The index deals token vectors to cells of centroids (fitted on a bounded sample);
an inverted list has, for each document in a cell, the least and largest angle of its
tokens to the centroid. As angles obey the triangle inequality, that bounds the cosine
of a query token with all of them, without reading a vector.

A search probes the most promising cells of every query token. What the lists say there, and
for all other cells the best that any of them could hold, bounds each document's score.
The documents of the highest bounds are scored exactly, then those others that reach the
k-th score found. While a document in no probed cell could reach it, too, the number of
probes is doubled. So results are those of scoring all documents with all their tokens.

Each block of queries reads the lists and takes some jobs, which pays for a few queries. More than a
block of them are scored with all documents instead, in larger blocks and a single job: every task reads whole
documents, takes the products with a block of bounded size and keeps its own best k a query.

Tokens without a vector or of another dimension than most count nothing; a document or
query without a token is in no result. Equal scores (by nine places) go to the smaller id.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.vectorindex import GROUP, k_means
from larkspur.operators.vectors import SEARCHED, _best, _fitting, _slices, _unit, lowest
from larkspur.shared import materialise

LISTS = "cell int, doc_id long, low double, high double, n long"
SLACK = 1e-6


class LateIndex:
    """An index of (doc_id, vector) token rows below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.centroids = np.load(io.BytesIO(bytes(spark.read.parquet(f"{self.path}/model").first()["model"])))["centroids"]
        ends = spark.read.parquet(f"{self.path}/cells").collect()  # a row a cell
        self.low, self.high = np.full(len(self.centroids), np.nan), np.full(len(self.centroids), np.nan)
        for r in ends:
            self.low[r["cell"]], self.high[r["cell"]] = r["low"], r["high"]

    @classmethod
    def build(cls, tokens: DataFrame, path: str, cells: int = 256, sample: int = 20_000) -> LateIndex:
        spark = tokens.sparkSession
        rows = tokens.where("doc_id is not null and vector is not null").select(F.col("doc_id").cast("long").alias("id"), "vector")
        kinds = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        wide = kinds["d"] if kinds else 1
        fitted = lowest(rows.where(F.size("vector") == wide), F.xxhash64("id", "vector"), sample)
        known = _unit(np.array([r["vector"] for r in fitted], np.float64)) if fitted else np.zeros((1, wide))
        centroids = _unit(k_means(known, cells))
        held = io.BytesIO()
        np.savez(held, centroids=centroids)
        spark.createDataFrame([(bytearray(held.getvalue()),)], "model binary").coalesce(1).write.parquet(f"{path}/model")
        sent = spark.sparkContext.broadcast(centroids)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, m = _fitting(batch, sent.value.shape[1])
                near = (m @ sent.value.T).argmax(axis=1) if len(ids) else np.empty(0, np.int64)
                angle = np.arccos(np.clip((m * sent.value[near]).sum(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near, pa.int32()), pa.array(angle, pa.float64())], names=["doc_id", "cell", "angle"])

        found = rows.mapInArrow(placed, "doc_id long, cell int, angle double").groupBy("cell", "doc_id").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
        lists = materialise(found, "late-lists")
        lists.repartitionByRange("cell", "doc_id").sortWithinPartitions("cell", "doc_id").write.option("parquet.block.size", GROUP).parquet(f"{path}/lists")
        lists.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).coalesce(1).write.parquet(f"{path}/cells")
        own = rows.where(F.size("vector") == wide).select(F.col("id").alias("doc_id"), "vector")
        own.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.option("parquet.block.size", GROUP).parquet(f"{path}/tokens")
        return cls(spark, path)

    def _queries(self, queries: DataFrame, block: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Whole queries of about ``block`` tokens: their ids, the owner of each token, the tokens."""
        rows = queries.where("query_id is not null").where(F.size("vector") == self.centroids.shape[1]).select("query_id", "vector").orderBy("query_id")
        ids, owner, tokens = [], [], []
        for query, vector in rows.toLocalIterator():
            if not ids or ids[-1] != query:
                if len(tokens) >= block:
                    yield ids, np.array(owner), _unit(np.array(tokens, np.float64))
                    ids, owner, tokens = [], [], []
                ids.append(query)
            owner.append(len(ids) - 1)
            tokens.append(vector)
        if ids:
            yield ids, np.array(owner), _unit(np.array(tokens, np.float64))

    def _scanned(self, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
        """(query_id, id, score): the best k documents of each task a query, from all tokens."""
        held = self.spark.read.schema("doc_id long, vector array<float>").parquet(f"{self.path}/tokens")
        whole = held.withColumnRenamed("doc_id", "id").repartition("id").sortWithinPartitions("id")
        parts = []
        for ids, owner, tokens in self._queries(queries, block):
            first = np.searchsorted(owner, np.arange(len(ids)))
            sent = self.spark.sparkContext.broadcast((np.array(ids), first, tokens))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                names, first, tokens = sent.value
                best = [(np.empty(0, np.int64), np.empty(0)) for _ in names]
                floor = np.full(len(names), -np.inf)
                last = None  # the document that may go on, with its best cosines so far

                def done(docs: np.ndarray, cosines: np.ndarray) -> None:
                    scores = np.round(np.add.reduceat(cosines, first, axis=1), 9)
                    for q in np.flatnonzero(scores.max(axis=0) >= floor):
                        hit = np.flatnonzero(scores[:, q] >= floor[q])
                        own, found = np.append(best[q][0], docs[hit]), np.append(best[q][1], scores[hit, q])
                        keep = _best(found, own, k)
                        best[q] = own[keep], found[keep]
                        if len(keep) == k:
                            floor[q] = found[keep[-1]]

                for batch in _slices(batches, len(tokens)):
                    doc, m = _fitting(batch, tokens.shape[1])
                    if not len(doc):
                        continue
                    starts = np.append(0, np.flatnonzero(doc[1:] != doc[:-1]) + 1)
                    docs, cosines = doc[starts], np.maximum.reduceat(m @ tokens.T, starts, axis=0)
                    if last is not None and last[0] == docs[0]:
                        cosines[0] = np.maximum(cosines[0], last[1])
                    elif last is not None:
                        docs, cosines = np.append(last[0], docs), np.vstack([last[1], cosines])
                    last = docs[-1], cosines[-1].copy()
                    if len(docs) > 1:
                        done(docs[:-1], cosines[:-1])
                if last is not None:
                    done(np.array([last[0]]), last[1][None])
                columns = [np.repeat(names, [len(i) for i, _ in best]), *(np.concatenate(c) for c in zip(*best, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "score"])

            parts.append(whole.mapInArrow(run, SEARCHED))
        return reduce(DataFrame.unionAll, parts)

    def _bounds(self, ids: list[int], owner: np.ndarray, tokens: np.ndarray, probes: int) -> tuple[DataFrame, np.ndarray]:
        """(query_id, id, bound) of the documents in probed cells, and the bound of all others by query."""
        theta = np.arccos(np.clip(tokens @ self.centroids.T, -1, 1))
        most = np.cos(np.maximum(0, np.maximum(theta - self.high, self.low - theta)))
        most = np.where(np.isnan(most), -np.inf, most)
        order = np.argsort(-most, axis=1, kind="stable")
        rest = np.take_along_axis(most, order[:, probes : probes + 1], axis=1)[:, 0] if probes < most.shape[1] else np.full(len(tokens), -np.inf)
        others = np.zeros(len(ids))
        np.add.at(others, owner, rest)
        floor = np.maximum(rest, -1.0)  # no cosine is smaller, so this bounds tokens all of whose cells are probed
        sums = np.zeros(len(ids))
        np.add.at(sums, owner, floor)
        rows = [(int(ids[owner[t]]), t, int(c), float(theta[t, c]), float(floor[t])) for t in range(len(tokens)) for c in order[t, :probes] if most[t, c] > -np.inf]
        asked = self.spark.createDataFrame(rows, "query_id long, token int, cell int, theta double, floor double")
        lists = self.spark.read.schema(LISTS).parquet(f"{self.path}/lists").where(F.col("cell").isin(sorted({r[2] for r in rows})))
        bound = F.cos(F.greatest(F.lit(0.0), F.col("theta") - F.col("high"), F.col("low") - F.col("theta")))
        # bounded: tokens of a block times probes
        each = lists.join(F.broadcast(asked), "cell").groupBy("query_id", "token", "doc_id", "floor").agg(F.max(bound).alias("bound"))
        base = F.broadcast(self.spark.createDataFrame([(int(q), float(s)) for q, s in zip(ids, sums, strict=True)], "query_id long, base double"))
        found = each.groupBy("query_id", F.col("doc_id").alias("id")).agg(F.sum(F.greatest("bound", "floor") - F.col("floor")).alias("gain")).join(base, "query_id")
        return materialise(found.select("query_id", "id", (F.col("base") + F.col("gain")).alias("bound")), "late-bounds"), others

    def _exact(self, ids: list[int], owner: np.ndarray, tokens: np.ndarray, pairs: DataFrame) -> DataFrame:
        """Scores of pairs (query_id, id)."""
        first = np.searchsorted(owner, np.arange(len(ids) + 1))
        sent = self.spark.sparkContext.broadcast((np.array(ids), first, tokens))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, first, tokens = sent.value
            for batch in batches:
                doc, m = _fitting(batch, tokens.shape[1])
                query = np.searchsorted(names, np.asarray(batch.column("query_id")))
                out = []
                for q in np.unique(query):
                    at = np.flatnonzero(query == q)
                    docs, number = np.unique(doc[at], return_inverse=True)
                    best = np.full((len(docs), first[q + 1] - first[q]), -2.0)
                    np.maximum.at(best, number, m[at] @ tokens[first[q] : first[q + 1]].T)
                    out.append((np.full(best.size, names[q]), np.repeat(docs, best.shape[1]), np.tile(np.arange(best.shape[1]), len(docs)), best.ravel()))
                if out:
                    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], names=["query_id", "id", "token", "best"])

        held = self.spark.read.schema("doc_id long, vector array<float>").parquet(f"{self.path}/tokens")
        each = pairs.select("query_id", F.col("id").alias("doc_id")).join(held, "doc_id").select("query_id", F.col("doc_id").alias("id"), "vector")
        best = each.mapInArrow(run, "query_id long, id long, token int, best double").groupBy("query_id", "id", "token").agg(F.max("best").alias("best"))
        return best.groupBy("query_id", "id").agg(F.round(F.sum("best"), 9).alias("score"))

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, block: int = 256, scan: bool | None = None) -> DataFrame:
        """The best k documents of each query (query_id, vector), a row a token: query_id, id, score, rank.

        ``scan`` chooses whether all documents are scored (unless given, for more than ``block`` tokens).
        """
        parts = []
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        asked = queries.where("query_id is not null").where(F.size("vector") == self.centroids.shape[1])
        if scan is None:
            scan = len(asked.limit(block + 1).select(F.lit(1)).collect()) > block
        if scan and not asked.isEmpty():
            return self._scanned(queries, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        for ids, owner, tokens in self._queries(queries, block):
            many = probes
            while ids:
                bounds, others = self._bounds(ids, owner, tokens, many)
                nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "id"))
                head = materialise(bounds.withColumn("nth", nth).where(F.col("nth") <= 4 * k).select("query_id", "id"), "late-first")
                hits = materialise(self._exact(ids, owner, tokens, head), "late-hits")
                floors = dict(hits.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select("query_id", "score").collect())  # a row a query of the block
                floor = np.array([floors.get(q, -np.inf) for q in ids])
                sure = (others < floor - SLACK) | (others == -np.inf)
                done = [q for q, s in zip(ids, sure.tolist(), strict=True) if s]
                reach = F.broadcast(self.spark.createDataFrame([(int(q), float(floors.get(q, -1e9))) for q in done], "query_id long, floor double"))
                more = bounds.join(reach, "query_id").where(F.col("bound") >= F.col("floor") - SLACK).select("query_id", "id").join(head, ["query_id", "id"], "left_anti")
                parts.append(hits.join(reach, "query_id", "left_semi").unionByName(self._exact(ids, owner, tokens, more)))
                # the others again, with more probes
                left = np.flatnonzero(~sure)
                keep = np.isin(owner, left)
                ids, owner, tokens, many = [ids[i] for i in left], np.searchsorted(left, owner[keep]), tokens[keep], 2 * many
        if not parts:
            return self.spark.createDataFrame([], "query_id long, id long, score double, rank int")
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
