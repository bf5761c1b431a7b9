"""Graphs as two DataFrames: vertices(id, ...) and edges(src, dst, ...).

Traversals are joins; iterations write their state to the shared folder, so plans
stay short and survive lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.shared import looked_up, materialise

SEPARATOR = "<SEP>"


def loaded(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Integrity at load: first vertex of an id, first edge of an ordered pair, both ends known.

    Both carry ``pos``; a weight that is no number is 1, created_at only if all digits.
    """
    first = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    v = vertices.withColumn("_n", first).where("_n = 1").drop("_n")
    known = v.select("id")
    e = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = e.withColumn("_n", F.row_number().over(Window.partitionBy("src", "dst").orderBy("pos"))).where("_n = 1").drop("_n")
    e = e.withColumn("weight", F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)))
    if "created_at" in e.columns:
        e = e.withColumn("created_at", F.when(F.col("created_at").rlike("^[0-9]+$"), F.col("created_at").cast("long")))
    return v, e


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; a self-loop stands twice."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def neighbours(edges: DataFrame, starts: DataFrame, directed: bool = True) -> DataFrame:
    """(start, neighbour) one hop from each of ``starts`` (id)."""
    out = edges.select("src", "dst") if directed else symmetric(edges)
    return out.join(starts.select(F.col("id").alias("src")), "src").select(F.col("src").alias("start"), F.col("dst").alias("neighbour")).distinct()


def paths(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, id, depth, path): all simple paths along edges, the start itself at depth 0."""
    step = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"), F.array("id").alias("path"))
    every = step
    for d in range(1, depth + 1):
        step = step.join(edges.select(F.col("src").alias("id"), "dst"), "id").where(~F.array_contains("path", F.col("dst")))
        step = step.select("start", F.col("dst").alias("id"), F.lit(d).alias("depth"), F.concat("path", F.array("dst")).alias("path"))
        every = every.unionAll(step)
    return every


def reachable(edges: DataFrame, starts: DataFrame, depth: int = 2, directed: bool = True) -> DataFrame:
    """(start, id, depth): each vertex once, at its smallest depth."""
    pairs = edges.select("src", "dst") if directed else symmetric(edges)
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"))
    front = seen
    for d in range(1, depth + 1):
        found = front.join(pairs.withColumnRenamed("src", "id"), "id").select("start", F.col("dst").alias("id")).distinct()
        front = found.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices with ``degree``; a self-loop counts 2, an isolated vertex 0."""
    counts = symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return vertices.join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(symmetric(edges).select(F.col("src").alias("id")), "id", "left_anti")


def isolated_detail(vertices: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    rows = isolated(vertices, edges).orderBy("pos").limit(limit)
    text = F.coalesce("description", F.lit(""))
    return rows.select("id", F.coalesce("type", F.lit("UNKNOWN")).alias("type"), F.length(text).alias("n_description"), F.left(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit(45)).alias("preview"))


#: Edges that a task folds at once, and nodes of a forest that it holds before it gives it away.
FOLDED, FOREST = 1 << 20, 1 << 18
#: Rows of a table that is broadcast whole.
SENT = 200_000


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each of n nodes' component by edges between them."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what edges (a, b) connect: each task gives stars, at most one edge a node that it has seen lately."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def folded() -> pa.RecordBatch:
            ends = [pa.concat_arrays([x.column(c) for x in held]) for c in ("a", "b")]
            nodes = pa.concat_arrays(ends).dictionary_encode()
            code = nodes.indices.to_numpy().astype(np.int64)
            root = _roots(code[: len(ends[0])], code[len(ends[0]) :], len(nodes.dictionary))
            below = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([nodes.dictionary.take(pa.array(x)) for x in (below, root[below])], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= FOLDED:
                stars = folded()
                if stars.num_rows > FOREST:
                    yield stars
                    held, n = [], 0
                else:
                    held, n = [stars], 0
        if held:
            yield folded()

    pairs = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    return pairs.mapInArrow(run, pairs.schema)


def _followed(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows joined with a written table of one row a key, by broadcast if that is small."""
    return rows.join(F.broadcast(table), key) if table.limit(SENT + 1).count() <= SENT else looked_up(rows, table, key)


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each (weak) component.

    Tasks first cut their edges to forests. In each round every node takes the name of the first of itself and its neighbours,
    by an order drawn anew, so that a constant share of the names that have edges is left, whatever the graph; edges between
    these names are cut to forests again, until none is left. Keys that very many nodes share are followed
    by broadcast. A repeated vertex counts once, an edge to what is no vertex counts nothing.
    """
    ids = vertices.select("id").distinct()
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    links = materialise(forest(pairs), "component-edges")
    ends = links.select("a").union(links.select("b")).distinct()
    if not ends.join(ids, F.col("a") == F.col("id"), "left_anti").isEmpty():
        for end in ("a", "b"):
            pairs = pairs.join(ids.withColumnRenamed("id", end), end, "left_semi")
        links = materialise(forest(pairs), "component-edges")
    labels, turn = None, 0
    while not links.isEmpty():  # the number of rounds grows with the logarithm of the number of nodes
        drawn = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("place"), F.col(c).alias("id"))
        both = links.select("a", "b").union(links.select("b", "a"))
        near = both.groupBy("a").agg(F.min(drawn("b")).alias("near")).select(F.col("a").alias("id"), F.least(drawn("a"), "near")["id"].alias("to"))
        near = materialise(near, "component-near")
        for end in ("a", "b"):
            links = _followed(links, near.withColumnRenamed("id", end), end).drop(end).withColumnRenamed("to", end)
            links = materialise(links if end == "a" else forest(links), "component-edges")
        if labels is None:
            labels = near
        else:
            tops = labels.select("to").distinct().join(near.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left")
            tops = materialise(tops.select("to", F.coalesce("next", "to").alias("next")), "component-tops")
            labels = materialise(_followed(labels, tops, "to").select("id", F.col("next").alias("to")), "component-labels")
        turn += 1
    if labels is None:
        return ids.select("id", F.col("id").alias("component"))
    least = materialise(labels.groupBy("to").agg(F.min("id").alias("component")), "component-least")
    return ids.join(_followed(labels, least, "to").drop("to"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, average and largest degree, isolated nodes and share, components."""
    d = degrees(vertices, edges).agg(
        F.count("*").alias("n_nodes"),
        F.coalesce(F.round(F.avg("degree"), 6), F.lit(0.0)).alias("avg_degree"),
        F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"),
        F.sum(F.when(F.col("degree") == 0, 1).otherwise(0)).alias("n_isolated"),
    )
    m = edges.agg(F.count("*").alias("n_edges"))
    c = components(vertices, edges).agg(F.count_distinct("component").alias("n_components"))
    share = F.round(100 * F.col("n_isolated") / F.col("n_nodes"), 4)
    return d.crossJoin(m).crossJoin(c).withColumn("isolated_pct", F.coalesce(share, F.lit(0.0)))


def density(vertices: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    n, m = F.col("n"), F.col("m")
    rows = vertices.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("m")))
    return rows.select("n", "m", F.round(F.when(n > 1, m * (1 if directed else 2) / (n * (n - 1))).otherwise(0.0), 9).alias("density"))


def top_degree(vertices: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    return degrees(vertices, edges).orderBy(F.desc("degree"), "pos").limit(n)


def induced(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the vertices."""
    keep = vertices.select("id")
    return edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def drawn(vertices: DataFrame, edges: DataFrame, n: int = 200) -> tuple[DataFrame, DataFrame]:
    """Sizes and widths for drawing the vertices of highest degree."""
    top = top_degree(vertices, edges, n).withColumn("size", F.greatest(F.least(F.col("degree") * 3, F.lit(40)), F.lit(10)))
    return top, induced(top, edges).withColumn("width", F.greatest(F.least(F.col("weight") * 2, F.lit(5.0)), F.lit(1.0)))


def chunk_index(vertices: DataFrame, column: str = "source_id") -> DataFrame:
    """(chunk_id, id) of every chunk that a vertex came from."""
    chunks = F.explode(F.filter(F.transform(F.split(column, SEPARATOR), lambda x: F.trim(x)), lambda x: x != ""))
    return vertices.select("id", chunks.alias("chunk_id")).distinct()


def provenance(vertices: DataFrame, chunks: DataFrame, most: int = 3, chars: int = 3000, column: str = "source_id") -> DataFrame:
    """(id, evidence): the first chunks' texts of each vertex, in list order."""
    listed = vertices.select("id", F.posexplode(F.filter(F.transform(F.split(column, SEPARATOR), lambda x: F.trim(x)), lambda x: x != "")).alias("at", "chunk_id"))
    held = listed.join(chunks.select("chunk_id", "content"), "chunk_id")
    held = held.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("at"))).where(F.col("n") <= most)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"])
    return held.groupBy("id").agg(F.left(F.array_join(texts, "\n---\n"), F.lit(chars)).alias("evidence"))


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Undirected edges in which a new edge overwrites the old one of its pair; the latest new one counts."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    pair = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy(F.desc("_age"), F.desc("pos"))
    return both.withColumn("_n", F.row_number().over(pair)).where("_n = 1").drop("_n", "_age")


def type_counts(vertices: DataFrame, column: str = "type") -> DataFrame:
    return vertices.groupBy(F.coalesce(column, F.lit("UNKNOWN")).alias("type")).agg(F.count("*").alias("n"))


def compared_types(a: DataFrame, b: DataFrame) -> DataFrame:
    """Type counts of two graphs side by side; absent ones are 0."""
    both = type_counts(a).withColumnRenamed("n", "n_a").join(type_counts(b).withColumnRenamed("n", "n_b"), "type", "full_outer")
    return both.fillna(0, ["n_a", "n_b"])


def extraction_records(text: Column, entity_fields: int = 3, relation_fields: int = 4) -> Column:
    """Records of an extraction answer: arrays of fields whose first is entity or relation."""
    body = F.substring_index(text, "<|COMPLETE|>", 1)
    records = F.transform(F.split(body, "\n"), lambda r: F.transform(F.split(F.trim(r), r"<\|#\|>"), lambda f: F.trim(f)))
    return F.filter(records, lambda r: ((r[0] == "entity") & (F.size(r) == entity_fields + 1)) | ((r[0] == "relation") & (F.size(r) == relation_fields + 1)))


