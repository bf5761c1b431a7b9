"""Vector search and similarity joins.

A set of queries is searched in blocks against all rows: each block is a broadcast
matrix of bounded size, every task multiplies its rows with it and keeps its own
best k a query, and a window picks the best of these. The corpus is read once a
block and only k rows a query and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.shared import materialise


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if a vector is zero, null if sizes differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norms > 0, dot(a, b) / norms).otherwise(0.0))


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries of one dimension each; when two blocks are held in all, the fullest goes."""
    held: dict[int, list] = {}
    for row in queries.select("query_id", "query_vector").where("query_vector is not null").toLocalIterator():
        held.setdefault(len(row[1]), []).append(row)
        full = len(row[1]) if len(held[len(row[1])]) == block else max(held, key=lambda d: len(held[d])) if sum(map(len, held.values())) >= 2 * block else None
        if full is not None:
            yield _stacked(held.pop(full))
    yield from map(_stacked, held.values())


def _stacked(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1 if len(rows[0][1]) else 0)


#: Scores that a task holds at once.
HELD = 1 << 19


def _slices(batches: Iterator[pa.RecordBatch], queries: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that all their rows' scores with that many queries are at most ``HELD``."""
    step = max(1, HELD // max(1, queries))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def lowest(rows: DataFrame, by: Column, most: int) -> list:
    """The ``most`` rows of the smallest hashes ``by``, then ids.

    Sorting sends as many rows to the driver from every task, so what is sorted is cut first to a range of hashes that holds
    about a quarter more than are wanted (all rows where it holds too few).
    """
    n = rows.count()
    if n > 2 * most:
        some = rows.where(by < int(-(2**63) + 2**64 * (1.25 * most / n)))
        if some.count() >= most:
            rows = some
    return rows.orderBy(by, "id").limit(most).collect()


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norms > 0, norms, 1)


def _fitting(batch: pa.RecordBatch, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows of a batch that have the dimension."""
    vectors = batch.column("vector")
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(sizes == dimensions)
    own = batch.column("id").to_numpy(zero_copy_only=False)[fits]
    if not len(fits) or not dimensions:
        return own, np.zeros((len(fits), dimensions))
    return own, _unit(vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), -1))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, those of smaller ids first among equals."""
    some = np.arange(len(scores))
    if len(scores) > 4 * k:  # all that reach the k-th score, which is found without sorting
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


SEARCHED = "query_id long, id long, score double"
TARGETS = "query_id long, id long, distances array<double>, low array<double>, high array<double>"


def search(queries: DataFrame, corpus: DataFrame, k: int, least: float | None = None, exclude_self: bool = False, block: int = 1024) -> DataFrame:
    """The k rows of ``corpus`` (id, vector) most alike to each of ``queries`` (query_id, query_vector).

    Ranked by cosine rounded to nine places, then by id. Rows of another dimension
    or without a vector are left out; ``least`` drops scores below it. Meant for a
    stated query set: the corpus is read once a block of queries, and each task keeps
    k rows a query. For queries that grow with the corpus see similarity_join.
    """
    parts = []
    send = corpus.sparkSession.sparkContext.broadcast
    for ids, matrix in _blocks(queries, block):
        sent = send((ids, _unit(matrix)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, wanted = sent.value
            held = [(np.empty(0, np.int64), np.empty(0)) for _ in names]  # this task's best so far
            for batch in _slices(batches, len(names)):
                own, rows = _fitting(batch, wanted.shape[1])
                if not len(own):
                    continue
                scores = np.round(rows @ wanted.T, 9)
                for q, name in enumerate(names):
                    ids, found = own, scores[:, q]
                    if least is not None or exclude_self:
                        keep = np.flatnonzero((found >= (-2 if least is None else least)) & ((ids != name) | (not exclude_self)))
                        ids, found = ids[keep], found[keep]
                    if len(held[q][0]) == k and (not len(found) or found.max() < held[q][1].min()):
                        continue
                    ids, found = np.append(held[q][0], ids), np.append(held[q][1], found)
                    best = _best(found, ids, k)
                    held[q] = ids[best], found[best]
            columns = [np.repeat(names, [len(i) for i, _ in held]), *(np.concatenate(c) for c in zip(*held, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "score"])

        parts.append(corpus.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(run, SEARCHED))
    if not parts:
        return corpus.sparkSession.createDataFrame([], f"{SEARCHED}, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return reduce(DataFrame.unionAll, parts).withColumn("rank", rank).where(F.col("rank") <= k)


def every_score(queries: DataFrame, corpus: DataFrame, places: int = 9, block: int = 1024) -> DataFrame:
    """(query_id, id, score): rounded cosines of a stated query set with all rows, block by block.

    Rows of another dimension or without a vector are left out.
    """
    parts = []
    send = corpus.sparkSession.sparkContext.broadcast
    for ids, matrix in _blocks(queries, block):
        sent = send((ids, _unit(matrix)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, wanted = sent.value
            for batch in _slices(batches, len(names)):
                own, rows = _fitting(batch, wanted.shape[1])
                if len(own):
                    scores = np.round(rows @ wanted.T, places)
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(names, len(own))), pa.array(np.repeat(own, len(names))), pa.array(scores.ravel())], names=["query_id", "id", "score"])

        parts.append(corpus.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(run, SEARCHED))
    return reduce(DataFrame.unionAll, parts) if parts else corpus.sparkSession.createDataFrame([], SEARCHED)


def target_distances(queries: DataFrame, corpus: DataFrame, targets: list[str], places: int = 9, block: int = 1024) -> DataFrame:
    """(query_id, id, distances, low, high): of each row of ``corpus`` (id, vector) to all ``targets``, vectors of ``queries`` (query_id, ...).

    Distances are rounded; ``low`` and ``high`` are the least and largest of the query by target, found by a
    pass of their own over the corpus, so that no pair is shuffled or written. Queries without one of their
    targets, and rows of another dimension than these, are left out.
    """
    spark = corpus.sparkSession
    wide = F.size(targets[0])
    whole = reduce(lambda a, b: a & b, [F.size(t) == wide for t in targets])
    joined = queries.where(whole).select("query_id", F.concat(*targets).alias("query_vector"))
    rows = corpus.select(F.col("id").cast("long").alias("id"), "vector")
    parts = []
    for ids, matrix in _blocks(joined, block):
        each = np.stack([_unit(m) for m in np.split(matrix, len(targets), axis=1)])  # target, query, dimension
        sent = spark.sparkContext.broadcast((ids, each))

        def far(batches: Iterator[pa.RecordBatch], sent) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            names, wanted = sent.value
            for batch in _slices(batches, len(names) * len(wanted)):
                own, m = _fitting(batch, wanted.shape[2])
                if len(own):  # row, query, target
                    yield names, own, np.round(1 - np.round(np.einsum("rd,tqd->rqt", m, wanted, optimize=True), places), places)

        def ends(batches: Iterator[pa.RecordBatch], sent=sent, far=far) -> Iterator[pa.RecordBatch]:
            low = high = None
            for names, _, found in far(batches, sent):
                few, most = found.min(axis=0), found.max(axis=0)
                low, high = (few, most) if low is None else (np.minimum(low, few), np.maximum(high, most))
            if low is not None:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(list(low)), pa.array(list(high))], names=["query_id", "low", "high"])

        found = rows.mapInArrow(ends, "query_id long, low array<double>, high array<double>").groupBy("query_id")
        both = [F.array(*[f(F.col(name)[i]) for i in range(len(targets))]).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
        extremes = {r["query_id"]: (r["low"], r["high"]) for r in found.agg(*both).collect()}  # a row a query of the block
        if not extremes:
            continue
        bounds = spark.sparkContext.broadcast([np.array([extremes[i][n] for i in ids.tolist()]) for n in (0, 1)])

        def pairs(batches: Iterator[pa.RecordBatch], sent=sent, far=far, bounds=bounds) -> Iterator[pa.RecordBatch]:
            for names, own, found in far(batches, sent):
                fixed = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), found.shape[2]).cast(pa.list_(pa.float64())) for a in (found, *(np.tile(b, (len(own), 1)) for b in bounds.value))]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(names, len(own))), pa.array(np.repeat(own, len(names))), *fixed], names=["query_id", "id", "distances", "low", "high"])

        parts.append(rows.mapInArrow(pairs, TARGETS))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], TARGETS)


def nearest_until(queries: DataFrame, corpus: DataFrame, k: int, places: int = 9, block: int = 1024) -> DataFrame:
    """(query_id, id, score): of corpus (id, vector, n), n rows sharing a vector, those that may be among a query's k nearest rows.

    A vector counts if fewer than k rows are strictly nearer. Each task keeps its nearest vectors until
    they stand for k rows, and only these are shuffled and counted again over all tasks: no
    more than k vectors, but for equal scores at the end, leave a task for a query.
    """
    parts = []
    send = corpus.sparkSession.sparkContext.broadcast

    def enough(scores: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Places of scores before which fewer than k rows stand."""
        order = np.argsort(-scores, kind="stable")
        ranked = scores[order]
        before = np.cumsum(weights[order]) - weights[order]
        first = np.searchsorted(-ranked, -ranked, side="left")  # of equal scores, the first
        return order[before[first] < k]

    for ids, matrix in _blocks(queries, block):
        sent = send((ids, _unit(matrix)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, wanted = sent.value
            held = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)) for _ in names]
            for batch in _slices(batches, len(names)):
                own, rows = _fitting(batch, wanted.shape[1])
                many = batch.column("n").to_numpy(zero_copy_only=False)[batch.column("vector").value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == wanted.shape[1]]
                scores = np.round(rows @ wanted.T, places) if len(own) else np.empty((0, len(names)))
                for q in range(len(names)):
                    i, s, n = (np.append(a, b) for a, b in zip(held[q], (own, scores[:, q], many), strict=True))
                    keep = enough(s, n)
                    held[q] = i[keep], s[keep], n[keep]
            columns = [np.repeat(names, [len(i) for i, *_ in held]), *(np.concatenate(c) for c in zip(*held, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "score", "n"])

        rows = corpus.select(F.col("id").cast("long").alias("id"), "vector", F.col("n").cast("long").alias("n"))
        parts.append(rows.mapInArrow(run, f"{SEARCHED}, n long"))
    if not parts:
        return corpus.sparkSession.createDataFrame([], SEARCHED)
    nearer = Window.partitionBy("query_id").orderBy(-F.round(F.col("score") * 10**places).cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    out = reduce(DataFrame.unionAll, parts).withColumn("nearer", F.coalesce(F.sum("n").over(nearer), F.lit(0)))
    return out.where(F.col("nearer") < k).select("query_id", "id", "score")


def similarity_join(queries: DataFrame, corpus: DataFrame, k: int, least: float, cells: int = 64, piece: int = 20_000, exclude_self: bool = False, grouped: bool = False) -> DataFrame:
    """As :func:`search` with ``least`` above 0, for queries (query_id, query_vector) that grow with the corpus (id, vector).

    Rows go to the cell of the nearest of ``cells`` pivots (rows of the smallest id
    hashes, the bound of what is fitted and broadcast). Angles obey the triangle
    inequality: a query meets a cell only if the angles of its rows to the pivot reach
    within arccos(least) of the query's own, so nothing is lost. Cells and their queries
    are split into pieces of about ``piece`` rows, each pair of pieces is a task of its
    own, and a task keeps k rows a query. The driver sees pivots and counts only.

    With ``grouped`` both sides have a column ``part`` and only rows of an equal one (nulls equal none) are hits.
    Vectors may differ in length: all are filled up with zeros, which changes no cosine, and only those of
    one length are hits. Parts and lengths are told apart by 64-bit hashes; null and empty vectors have no hits.
    """
    spark = corpus.sparkSession
    wide = max(corpus.agg(F.max(F.size("vector"))).first()[0] or 0, 0)

    def filled(df: DataFrame, name: str, vector: str) -> DataFrame:
        own = df.where(F.size(vector).between(1, wide) & (F.col("part").isNotNull() if grouped else F.lit(True)))
        part = F.xxhash64("part", F.size(vector)) if grouped else F.size(vector).cast("long")
        zeros = F.array_repeat(F.lit(0.0), F.lit(wide) - F.size(vector))
        return own.select(F.col(name).cast("long").alias("id"), F.concat(F.col(vector).cast("array<double>"), zeros).alias("vector"), part.alias("part"))

    rows, asked = filled(corpus, "id", "vector"), filled(queries, "query_id", "query_vector")
    pivots = [r["vector"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(cells).collect()]
    if not pivots:
        return spark.createDataFrame([], f"{SEARCHED}, rank int")
    center = _unit(np.array(pivots, np.float64))
    sent, reach = spark.sparkContext.broadcast(center), float(np.arccos(np.clip(least, -1, 1))) + 1e-6

    def parts(batch: pa.RecordBatch) -> np.ndarray:
        return np.asarray(batch.column("part"))[batch.column("vector").value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == sent.value.shape[1]]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, m = _fitting(batch, sent.value.shape[1])
            angles = np.arccos(np.clip(m @ sent.value.T, -1, 1))
            cell = angles.argmin(axis=1) if len(ids) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(m), pa.list_(pa.float64())), pa.array(parts(batch), pa.int64()), pa.array(cell, pa.int64()), pa.array(angles[np.arange(len(ids)), cell], pa.float64())], names=["id", "vector", "part", "cell", "angle"])

    held = materialise(rows.mapInArrow(placed, "id long, vector array<double>, part long, cell long, angle double"), "similarity-cells")
    known = {r["cell"]: r for r in held.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).collect()}
    low, high = (np.array([known[c][n] if c in known else np.nan for c in range(len(center))]) for n in ("low", "high"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, m = _fitting(batch, sent.value.shape[1])
            angles = np.arccos(np.clip(m @ sent.value.T, -1, 1))
            at, cell = np.nonzero((angles - reach <= high) & (angles + reach >= low))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(list(m[at]), pa.list_(pa.float64())), pa.array(parts(batch)[at], pa.int64()), pa.array(cell, pa.int64())], names=["id", "vector", "part", "cell"])

    wanted = asked.mapInArrow(met, "id long, vector array<double>, part long, cell long")
    numbers = {r["cell"]: r["n"] for r in wanted.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    sizes = [(c, -(-known[c]["n"] // piece), -(-numbers[c] // piece)) for c in numbers]
    pieces = F.broadcast(spark.createDataFrame(sizes, "cell long, here int, there int"))  # a row a cell

    def split(rows: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(names[0])
        return rows.join(pieces, "cell").select("cell", "id", "vector", "part", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1]))

    left, right = split(wanted, "there", "here", ("q", "c")), split(held, "here", "there", ("c", "q"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            ids, own = a.column("id").to_numpy(), b.column("id").to_numpy()
            asked_of, part_of = a.column("part").to_numpy(), b.column("part").to_numpy()
            mine, theirs = (np.stack([np.asarray(v) for v in t.column("vector").to_pylist()]) for t in (a, b))
            for start in range(0, len(ids), 1024):
                scores = np.round(mine[start : start + 1024] @ theirs.T, 9)
                for name, of, found in zip(ids[start : start + 1024].tolist(), asked_of[start : start + 1024].tolist(), scores, strict=True):
                    keep = np.flatnonzero((found >= least) & (part_of == of) & ((own != name) | (not exclude_self)))
                    keep = keep[_best(found[keep], own[keep], k)]
                    out += [(name, i, x) for i, x in zip(own[keep].tolist(), found[keep].tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "id", "score"])

    hits = left.groupBy("cell", "q", "c").cogroup(right.groupBy("cell", "q", "c")).applyInArrow(best, SEARCHED)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def mean_pooled(rows: DataFrame) -> DataFrame:
    """(id, vector): the mean of the vectors of each id's tokens (id, vector), of length 1; zero stays zero."""
    each = rows.where("vector is not null").select("id", F.posexplode("vector").alias("at", "x")).groupBy("id", "at").agg(F.avg("x").alias("x"))
    pooled = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return pooled.select("id", F.transform("vector", lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).alias("vector"))


def relative(distances: list[Column], low: list[Column], high: list[Column], weights: list[float]) -> Column:
    """The weighted sum of distances stretched to 0..1 between their ends; equal ends give 0."""
    parts = [F.when(h > a, (d - a) / (h - a)).otherwise(0.0) * w for d, a, h, w in zip(distances, low, high, weights, strict=True)]
    return reduce(lambda a, b: a + b, parts)


def relative_targets(distances: DataFrame, weights: dict[str, float], by: str | None = None) -> DataFrame:
    """Rows with ``relative``: the weighted sum of each target's distances stretched to 0..1 (equal ones are all 0).

    Over all rows, whose least and largest distances are one row, or over those of each ``by``.
    """
    extremes = [f(k).alias(f"_{n}_{k}") for k in weights for n, f in (("low", F.min), ("high", F.max))]
    ends = distances.groupBy(by).agg(*extremes) if by else distances.agg(*extremes)
    rows = distances.join(ends, by) if by else distances.crossJoin(F.broadcast(ends))
    low, high = ([F.col(f"_{n}_{k}") for k in weights] for n in ("low", "high"))
    return rows.withColumn("relative", relative([F.col(k) for k in weights], low, high, list(weights.values()))).drop(*[c for c in ends.columns if c != by])


def scaled(hits: DataFrame) -> DataFrame:
    """Scores of a store that maps cosines to 0..1."""
    return hits.withColumn("score", F.round((1 + F.col("score")) / 2, 4))


RESCORED = "query_id long, id long, score double, distance int"


def rescored(queries: DataFrame, corpus: DataFrame, k: int, oversample: int = 4, block: int = 1024) -> DataFrame:
    """The k rows of ``corpus`` (id, vector) most alike to each of ``queries``, by sign bits and exact cosines.

    Every batch scores the ``k * oversample`` rows nearest by differing sign bits, then
    the others whose bound reaches the k-th score found: where signs differ, products
    are not positive, so a cosine is at most the length of the unit query over the
    dimensions whose signs agree. No row of the exact answer is lost. Ranked by cosine
    rounded to six places, then by id.
    """
    parts = []
    send = corpus.sparkSession.sparkContext.broadcast
    for ids, matrix in _blocks(queries, block):
        sent = send((ids, _unit(matrix)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, wanted = sent.value
            signs = np.packbits(wanted > 0, axis=1)
            weights = np.where(wanted > 0, wanted, -wanted) * wanted  # signed squares
            for batch in batches:
                vectors = batch.column("vector")
                sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                fits = np.flatnonzero(sizes == wanted.shape[1])
                if not len(fits):
                    continue
                rows = _unit(vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), -1))
                own = batch.column("id").to_numpy(zero_copy_only=False)[fits]
                positive = rows > 0
                bits = np.packbits(positive, axis=1)
                bounds = np.sqrt(np.maximum(((wanted**2).sum(axis=1) + np.where(positive, 1.0, -1.0) @ weights.T) / 2, 0))
                found = []
                for q in range(len(names)):
                    distance = np.bitwise_count(bits ^ signs[q]).sum(axis=1, dtype=np.int32)
                    order = np.lexsort((own, distance))
                    near, far = order[: k * oversample], order[k * oversample :]
                    scores = np.round(rows[near] @ wanted[q], 6)
                    if len(far):
                        least = np.sort(scores)[-k]
                        far = far[bounds[far, q] >= least - 1e-6]
                        near, scores = np.append(near, far), np.append(scores, np.round(rows[far] @ wanted[q], 6))
                    best = np.lexsort((own[near], -scores))[:k]
                    found.append((np.full(len(best), names[q]), own[near[best]], scores[best], distance[near[best]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["query_id", "id", "score", "distance"])

        parts.append(corpus.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(run, RESCORED))
    if not parts:
        return corpus.sparkSession.createDataFrame([], f"{RESCORED}, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return reduce(DataFrame.unionAll, parts).withColumn("rank", rank).where(F.col("rank") <= k)


def joined_targets(distances: dict[str, Column], how: str, weights: dict[str, float] | None = None) -> Column:
    """One distance out of several target vectors' distances.

    ``how``: minimum, sum, average, or manual (weighted sum).
    """
    values = list(distances.values())
    total = reduce(lambda a, b: a + b, values)
    if how == "minimum":
        return F.least(*values) if len(values) > 1 else values[0]
    if how == "sum":
        return total
    if how == "average":
        return total / len(values)
    if how == "manual":
        return reduce(lambda a, b: a + b, [distances[k] * w for k, w in (weights or {}).items()])
    raise ValueError(f"unknown way to join targets: {how}")
