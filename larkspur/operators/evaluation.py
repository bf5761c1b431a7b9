"""Quality of retrieval and answers, as aggregates over judged hits.

Lists are rows (query_id, list_id, rank, id), judgements rows (query_id, id, grade);
what nobody judged has grade 0. All measures are groupings by query and list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import tokens
from larkspur.operators.passages import sentences


def gain(grade: Column, rank: Column) -> Column:
    """Discounted gain of a grade at a rank from 1."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def ranking(lists: DataFrame, judged: DataFrame, k: int, relevant: int = 1) -> DataFrame:
    """(query_id, list_id, ndcg, mrr, precision, recall) of each list's first ``k``.

    ``ndcg`` divides by the best order of all judged documents of the query (0 if none has a grade),
    ``mrr`` is one over the rank of the first document of grade ``relevant`` or more (0 if there is none),
    ``precision`` the mean, over the ranks of such documents, of their share up to there (context precision), and ``recall``
    their share of all such documents (0 if there are none). A document counts at its best rank.
    """
    first = lists.groupBy("query_id", "list_id", "id").agg(F.min("rank").alias("rank")).where(F.col("rank") <= k)
    grades = judged.groupBy("query_id", "id").agg(F.max("grade").alias("grade"))
    rows = first.join(grades, ["query_id", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    good = (F.col("grade") >= relevant).cast("int")
    upto = F.sum(good).over(Window.partitionBy("query_id", "list_id").orderBy("rank", "id"))
    rows = rows.withColumn("share", F.when(good == 1, upto / F.col("rank")))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id"))
    ideal = grades.withColumn("place", best).groupBy("query_id").agg(F.sum(F.when(F.col("place") <= k, gain(F.col("grade"), F.col("place")))).alias("ideal"), F.sum((F.col("grade") >= relevant).cast("int")).alias("n"))
    got = rows.groupBy("query_id", "list_id").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"), F.max(F.when(good == 1, 1.0 / F.col("rank"))).alias("mrr"), F.avg("share").alias("precision"), F.sum(good).alias("hit"))
    out = got.join(ideal, "query_id", "left")
    zero = F.lit(0.0)
    return out.select(
        "query_id", "list_id", F.when(F.col("ideal") > 0, F.round(F.col("dcg") / F.col("ideal"), 9)).otherwise(zero).alias("ndcg"), F.coalesce("mrr", zero).alias("mrr"),
        F.round(F.coalesce("precision", zero), 9).alias("precision"), F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(zero).alias("recall"),
    )


def faithfulness(answers: DataFrame, contexts: DataFrame, share: float = 0.8) -> DataFrame:
    """(query_id, n_claims, n_supported, faithfulness): how many claims of an answer its context bears out.

    Claims are the sentences of ``answers`` (query_id, answer); one is supported if at least ``share`` of its
    distinct words stand in some one text of ``contexts`` (query_id, text). An answer without a claim is not there.
    """
    claims = answers.select("query_id", F.posexplode(sentences(F.col("answer"))).alias("n", "claim"))
    words = F.array_distinct(tokens(F.col("claim")))
    claims = claims.select("query_id", "n", words.alias("words")).where(F.size("words") > 0)
    texts = contexts.select("query_id", F.array_distinct(tokens(F.coalesce("text", F.lit("")))).alias("held"))
    held = F.size(F.array_intersect("words", "held")) / F.size("words")
    each = claims.join(texts, "query_id", "left").groupBy("query_id", "n").agg(F.max(F.coalesce(held, F.lit(0.0))).alias("held"))
    out = each.groupBy("query_id").agg(F.count("*").alias("n_claims"), F.sum((F.col("held") >= share).cast("long")).alias("n_supported"))
    return out.withColumn("faithfulness", F.col("n_supported") / F.col("n_claims"))
