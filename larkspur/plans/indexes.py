"""Indexes that outlive a query: text, vectors and token vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import vectors
from larkspur.operators.late import LateIndex
from larkspur.operators.textindex import TextIndex
from larkspur.operators.vectorindex import VectorIndex, recall
from larkspur.plans import retrieval as r
from larkspur.shared import shared_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("text_index_topk", r.SQL["bm25_topk"])
def text_index(spark, sf):
    """The hits of bm25_topk from a written index, by ranges whose bounds reach them."""
    index = TextIndex(spark, shared_path(spark, "text-index"))
    index.apply(r.docs(spark, sf))
    return index.search(r.items(spark, sf), 3)


def earlier(docs):
    """Documents as an index may have had them before: some missing, some other texts, some that are gone now."""
    text = F.when(F.col("id") % 5 == 1, F.concat(F.lit("old "), F.substring("text", 1, 200))).otherwise(F.col("text"))
    gone = docs.where("id % 7 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "text")
    return docs.where("id % 3 <> 0").select("id", text.alias("text")).unionByName(gone)


@query("text_index_changes", "SELECT op, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'insert' WHEN doc_id % 5 = 1 THEN 'edit' END AS op FROM documents UNION ALL SELECT 'delete' FROM documents WHERE doc_id % 7 = 0) WHERE op IS NOT NULL GROUP BY op")
def text_changes(spark, sf):
    """What leads from an earlier state of the documents to theirs, by content hash."""
    index = TextIndex(spark, shared_path(spark, "text-index"))
    index.apply(earlier(r.docs(spark, sf).select("id", "text")))
    return index.changes(r.docs(spark, sf)).groupBy("op").agg(F.count("*").alias("n"))


@query("text_index_refreshed", r.SQL["bm25_topk"])
def text_refreshed(spark, sf):
    """As bm25_topk, after inserts, edits and deletes have led from an earlier state to the documents."""
    index = TextIndex(spark, shared_path(spark, "text-index"))
    index.apply(earlier(r.docs(spark, sf).select("id", "text")))
    index.refresh(r.docs(spark, sf).select("id", "text"))
    return index.search(r.items(spark, sf), 3)


@query("vector_index_exact", r.SQL["vec_topk"])
def vector_exact(spark, sf):
    """The hits of vec_topk from codes, exact by their bounds."""
    index = VectorIndex.build(r.corpus(spark, sf), shared_path(spark, "vector-index"))
    return index.search(r.probes(spark, sf), 10, exact=True).withColumn("score", F.round("score", 4))


@query("vector_index_recall")
def vector_recall(spark, sf):
    """How many of each query's true ten the index finds without its exact step."""
    index = VectorIndex.build(r.corpus(spark, sf), shared_path(spark, "vector-index"))
    return recall(index.search(r.probes(spark, sf), 10), vectors.search(r.probes(spark, sf), r.corpus(spark, sf), 10)).withColumn("code_bytes", F.lit(index.code_bytes))


@query("late_interaction", """
    WITH T AS (SELECT vec_id, i, embedding[i * 16 + 1:(i + 1) * 16]::DOUBLE[] AS v FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS i)),
    S AS (SELECT q.vec_id AS query_id, e.vec_id AS id, q.i, max(list_cosine_similarity(q.v, e.v)) AS best FROM T q JOIN T e ON q.vec_id % 50 = 0 GROUP BY ALL),
    M AS (SELECT query_id, id, round(sum(best), 9) AS score FROM S GROUP BY query_id, id)
    SELECT query_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM M) WHERE rank <= 10""")
def late(spark, sf):
    """The quarters of each vector are its token vectors; the stated query set against all rows."""
    quarters = F.explode(F.array(*[F.slice("vector", 16 * i + 1, 16) for i in range(4)])).alias("vector")
    tokens = r.corpus(spark, sf).select(F.col("id").alias("doc_id"), quarters)
    index = LateIndex.build(tokens, shared_path(spark, "late-index"))
    return index.search(tokens.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), 10).withColumn("score", F.round("score", 6))
