"""Semantic and exact caches as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import short_id
from larkspur.operators import vectors


def live(entries: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Entries younger than their time to live."""
    return entries.where(F.col("created_at") > now - F.expr(f"interval {hours} hours"))


def lookup(requests: DataFrame, entries: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(request_id, best_score, hit, answer) of requests (request_id, vector) among entries (id, vector, answer).

    Entries without an answer or of another dimension are skipped; the best score
    starts at 0, so negative cosines never match; misses keep their best score.
    """
    usable = entries.where(F.coalesce("answer", F.lit("")) != "")
    hits = vectors.search(requests.select(F.col("request_id").alias("query_id"), F.col("vector").alias("query_vector")), usable.select("id", "vector"), 1)
    best = hits.where("score > 0").join(usable.select("id", "answer"), "id")
    out = requests.select("request_id").join(best.withColumnRenamed("query_id", "request_id"), "request_id", "left")
    score = F.coalesce("score", F.lit(0.0))
    return out.select("request_id", F.round(score, 6).alias("best_score"), (score >= threshold).alias("hit"), F.when(score >= threshold, F.col("answer")).alias("answer"))


def upserted(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries by the first 12 digits of the query's md5; the latest of a key counts."""
    both = entries.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1))).withColumn("key", short_id(F.col("query")))
    order = Window.partitionBy("key").orderBy(F.desc("_age"), F.desc("created_at"), F.desc("query"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_age")


def same_dimension(entries: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """Usable entries and those to set aside."""
    fits = F.size("vector") == dimensions
    return entries.where(fits), entries.where(~F.coalesce(fits, F.lit(False)))


def answered(requests: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (prompt) with cached responses (hash, response), and those left for a model."""
    keyed = requests.withColumn("hash", F.md5("prompt"))
    return keyed.join(responses, "hash"), keyed.join(responses.select("hash"), "hash", "left_anti")


def summary(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("n_entries"), F.coalesce(F.round(F.sum("cost"), 6), F.lit(0.0)).alias("total_cost"))


def hit_ratio(calls: DataFrame) -> DataFrame:
    """One row from calls (cached boolean)."""
    hits = F.coalesce(F.sum(F.when(F.col("cached"), 1).otherwise(0)), F.lit(0))
    return calls.agg(F.count("*").alias("n_calls"), hits.alias("n_hits"), F.coalesce(F.round(hits / F.count("*"), 6), F.lit(0.0)).alias("hit_ratio"))
