"""Fusion, merging, reranking and context assembly of ranked hits.

Ranked lists are flat rows (query_id, list_id, rank, id, ...), never nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import SOURCE_MARK

#: Rerank weights by sub-score.
WEIGHTS = {"relevance": 0.60, "specificity": 0.15, "completeness": 0.10, "practicality": 0.10, "constraint_fit": 0.05}
EMPTY_CONTEXT = "(no documents)"


def reciprocal_rank(lists: DataFrame, top_k: int = 5, k: int = 60, rank_base: int = 0) -> DataFrame:
    """Reciprocal rank fusion of rows (query_id, list_id, rank, id), rank counted from 1.

    Scores are summed by document; equal sums keep the order in which documents
    were first seen (list by list); the score is rounded after ordering.
    """
    share = 1.0 / (F.col("rank") - 1 + rank_base + k)
    fused = lists.groupBy("query_id", "id").agg(F.sum(share).alias("raw"), F.min(F.struct("list_id", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("raw", 12)), "first")
    out = fused.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top_k)
    return out.select("query_id", "id", F.round("raw", 6).alias("score"), "position")


def min_max(score: Column, over: Window) -> Column:
    """A list's scores stretched to 0..1; a list of equal scores is all 1."""
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(high > low, (score - low) / (high - low)).otherwise(1.0)


def weighted(vector: DataFrame, keyword: DataFrame, alpha: float = 0.5, limit: int = 5) -> DataFrame:
    """Relative-score fusion of two lists (query_id, id, score); absent documents count 0."""
    over = Window.partitionBy("query_id")
    a, b = (x.select("query_id", "id", min_max(F.col("score"), over).alias(n)) for x, n in ((vector, "v"), (keyword, "w")))
    both = a.join(b, ["query_id", "id"], "full_outer")
    score = alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("w", F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    out = both.select("query_id", "id", score.alias("score")).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= limit).withColumn("score", F.round("score", 6))


def merged(hits: DataFrame, order: list[str], key: list[Column]) -> DataFrame:
    """The first hit of each key."""
    names = [f"_k{i}" for i in range(len(key))]
    keyed = hits.withColumns(dict(zip(names, key, strict=True)))
    nth = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    return keyed.withColumn("_n", nth).where("_n = 1").drop("_n", *names)


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys of both lists, of one alone, and whether they agree (two or more in common)."""
    left, right = (x.select(*keys).distinct() for x in (a, b))
    both = left.withColumn("in_a", F.lit(1)).join(right.withColumn("in_b", F.lit(1)), keys, "full_outer")
    out = both.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(n) for n, c in (("common", F.col("in_a").isNotNull() & F.col("in_b").isNotNull()), ("only_a", F.col("in_b").isNull()), ("only_b", F.col("in_a").isNull()))])
    return out.withColumn("consistent", F.col("common") >= 2)


def weighted_score(scale: float = 10, weights: dict[str, float] = WEIGHTS) -> Column:
    """Share of the highest possible weighted score; a missing sub-score is 0, one out of range gives null."""
    total = sum(weights.values())
    inside = F.lit(True)
    score = F.lit(0.0)
    for name, weight in weights.items():
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        inside = inside & value.between(0, scale)
        score = score + value / scale * weight
    return F.when(inside, score / total)


def reranked(hits: DataFrame, score: Column, threshold: float, top_k: int | None = None, ties: str = "id") -> DataFrame:
    """Hits whose score reaches the threshold, ranked from 1; a null score counts 0."""
    scored = hits.withColumn("rerank_score", F.round(F.coalesce(score, F.lit(0.0)), 9)).where(F.col("rerank_score") >= threshold)
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), ties)
    out = scored.withColumn("rerank_rank", F.row_number().over(order))
    return out if top_k is None else out.where(F.col("rerank_rank") <= top_k)


def context(hits: DataFrame, by: list[str], order: list[str], style: str = "numbered") -> DataFrame:
    """Prompt context of each group: numbered titles and texts, or sources with scores.

    Groups without a hit get a marker when joined from outside; see EMPTY_CONTEXT.
    """
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    if style == "numbered":
        text, between = F.concat(F.lit("["), nth.cast("string"), F.lit("] "), "title", F.lit("\n"), "text"), "\n\n"
    else:
        text, between = F.concat(F.lit(f"[{SOURCE_MARK}: "), "source", F.lit(" / "), "section", F.lit(" | RRF: "), F.format_string("%.4f", "score"), F.lit("]\n"), "content"), "\n\n---\n\n"
    rows = hits.withColumn("_n", nth).withColumn("_t", text)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"])
    return rows.groupBy(*by).agg(F.array_join(parts, between).alias("context"))


def round_robin(lists: DataFrame, key: str = "id", limit: int | None = None) -> DataFrame:
    """One list out of several (query_id, list_id, rank): by rank, then list, first sight of a key wins."""
    first = merged(lists, ["rank", "list_id"], [F.col("query_id"), F.col(key)])
    order = Window.partitionBy("query_id").orderBy("rank", "list_id")
    out = first.withColumn("position", F.row_number().over(order))
    return out if limit is None else out.where(F.col("position") <= limit)
