"""Retrieval that adapts: routes fitted from outcomes, and retrieval inside a draft where it is unsure.

A route is the number of retrieval rounds that a question is given (0: none, 1: single,
more: iterative). It is chosen before anything is retrieved, from features whose buckets
were counted over questions with known outcomes. The model is a table of routes x
features x buckets rows, whatever the number of questions, so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import tokens
from larkspur.operators import lexical
from larkspur.shared import materialise


def covered(wanted: Column, held: Column) -> Column:
    """Share of the distinct words ``wanted`` that stand in ``held``; 1 if none is wanted."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, held)) / F.size(wanted)).otherwise(1.0)


def outcomes(reached: DataFrame, enough: float) -> DataFrame:
    """(query_id, route): the shortest route whose ``coverage`` is ``enough``, else the shortest of the best.

    ``reached`` has rows (query_id, route, coverage); a null coverage counts as 0.
    """
    share = F.coalesce("coverage", F.lit(0.0))
    first = F.min(F.when(share >= enough, F.col("route")))
    best = F.min_by("route", F.struct(-share, F.col("route")))
    return reached.groupBy("query_id").agg(F.coalesce(first, best).alias("route"))


def question_features(index: lexical.Index, questions: DataFrame) -> DataFrame:
    """(query_id, features): buckets 0..7 of what an index knows of questions (query_id, query), without a search.

    In order: distinct terms in fours, mean idf in halves, eighths of the terms that no document has, largest
    idf in ones. An unknown term has the idf of no document. A question without terms is all zeros.
    """
    terms = lexical.asked_terms(questions).join(index.frequencies, "term", "left").crossJoin(F.broadcast(index.stats))
    df = F.coalesce("df", F.lit(0))
    idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
    each = terms.groupBy("query_id").agg(F.count("*").alias("m"), F.round(F.avg(idf), 6).alias("mean"), F.round(F.max(idf), 6).alias("most"), F.sum(F.col("df").isNull().cast("int")).alias("unknown"))
    made = [F.col("m") / 4, F.col("mean") * 2, F.col("unknown") * 8 / F.col("m"), F.col("most")]
    buckets = F.array(*[F.least(F.floor(x), F.lit(7)).cast("int") for x in made])
    return questions.select("query_id").distinct().join(each.select("query_id", buckets.alias("features")), "query_id", "left").select("query_id", F.coalesce("features", F.array(*[F.lit(0)] * len(made))).alias("features"))


def fit(labelled: DataFrame, features: int, routes: int = 3, buckets: int = 8) -> DataFrame:
    """(feature, bucket, route, weight): logarithms of smoothed shares of rows (route, features) by route.

    Feature 0, bucket 0 is the route's own share, feature n the n-th feature of the array. What was never seen counts
    one, so an empty table gives equal weights. Null features are bucket 0, buckets beyond the ends the last ones.
    """
    spark = labelled.sparkSession
    n = F.broadcast(labelled.where("route is not null").groupBy("route").agg(F.count("*").alias("n")))
    total = F.broadcast(labelled.agg(F.count("route").alias("total")))
    seen = labelled.select("route", *_exploded(buckets)).groupBy("feature", "bucket", "route").agg(F.count("*").alias("hits"))
    grid = spark.range(routes * features * buckets).select((F.col("id") % routes).cast("int").alias("route"), (F.floor(F.col("id") / routes) % buckets).cast("int").alias("bucket"), (F.floor(F.col("id") / (routes * buckets)) + 1).cast("int").alias("feature"))
    grid = grid.unionByName(spark.range(routes).select(F.col("id").cast("int").alias("route"), F.lit(0).alias("bucket"), F.lit(0).alias("feature")))
    rows = grid.join(seen, ["feature", "bucket", "route"], "left").join(n, "route", "left").crossJoin(total)
    own, of = F.coalesce("n", F.lit(0)), F.coalesce("hits", F.lit(0))
    weight = F.when(F.col("feature") == 0, F.log((own + 1) / (F.col("total") + routes))).otherwise(F.log((of + 1) / (own + buckets)))
    return rows.select("feature", "bucket", "route", weight.alias("weight"))


def _exploded(buckets: int) -> list[Column]:
    every = F.transform("features", lambda b: F.least(F.greatest(F.coalesce(b, F.lit(0)), F.lit(0)), F.lit(buckets - 1)).cast("int"))
    return [F.posexplode(F.concat(F.array(F.lit(0)), every)).alias("feature", "bucket")]


def routed(model: DataFrame, asked: DataFrame, buckets: int = 8) -> DataFrame:
    """(query_id, route, confidence): the likeliest route of rows (query_id, features), the shorter one of equals.

    Of rows that share a query_id the smallest features count.
    """
    one = asked.groupBy("query_id").agg(F.min("features").alias("features"))
    each = one.select("query_id", *_exploded(buckets)).join(F.broadcast(model), ["feature", "bucket"])
    scores = each.groupBy("query_id", "route").agg(F.round(F.sum("weight"), 9).alias("score"))
    best = scores.groupBy("query_id").agg(F.max_by("route", F.struct(F.col("score"), -F.col("route"))).alias("route"), F.max("score").alias("top"), F.collect_list("score").alias("all"))
    share = 1 / F.aggregate(F.array_sort("all"), F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    return best.select("query_id", "route", F.round(share, 6).alias("confidence"))


def active(spans: DataFrame, docs: DataFrame, least: float = 0.8, rounds: int = 3) -> DataFrame:
    """(query_id, span, confidence, round, id): drafts that retrieve where they are unsure.

    ``spans`` are the parts (query_id, span, text) of drafts, in order, each once. A span's confidence is the share of
    its distinct words that stand in the documents (id, text) retrieved for its draft so far; a span
    without words has 1. Each round every draft goes to its next span below ``least`` and retrieves the best
    document that it does not have yet, by the span's words; ``round`` and ``id`` tell which (null ``id``: no other document
    has any of them). A draft ends when it has no such span left, or after ``rounds`` rounds, so the number of searches
    is bounded. The confidence returned is the last one. Drafts advance together: a round is one search.
    """
    spans = materialise(spans.select("query_id", "span", "text"), "active-spans")
    words = materialise(spans.select("query_id", "span", F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("term")), "active-words")
    index = lexical.index(docs, words.select("query_id", F.col("term").alias("query")))
    held = None  # (query_id, span, round, id) of the searches so far

    def confidences() -> DataFrame:
        rows = words.withColumn("held", F.lit(0))
        if held is not None:
            own = lexical.with_documents(held.where("id is not null").select("id").distinct(), docs).select("id", F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("term"))
            known = held.join(own, "id").select("query_id", "term", F.lit(1).alias("_held")).distinct()
            rows = words.join(known, ["query_id", "term"], "left").withColumn("held", F.coalesce("_held", F.lit(0)))
        share = rows.groupBy("query_id", "span").agg(F.avg("held").alias("confidence"))
        return spans.select("query_id", "span").join(share, ["query_id", "span"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))

    for number in range(1, rounds + 1):
        unsure = confidences().where(F.col("confidence") < least)
        if held is not None:
            last = held.groupBy("query_id").agg(F.max("span").alias("last"))
            unsure = unsure.join(last, "query_id", "left").where(F.coalesce(F.col("span") > F.col("last"), F.lit(True)))
        now = materialise(unsure.groupBy("query_id").agg(F.min("span").alias("span")), "active-now")
        if now.isEmpty():
            break
        asked = now.join(words, ["query_id", "span"]).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("query"))
        hits = lexical.search(index, asked, number, places=15).drop("rank")  # a draft has number - 1 at most
        if held is not None:
            hits = hits.join(held.where("id is not null").select("query_id", "id"), ["query_id", "id"], "left_anti")
        found = now.join(lexical.ranked(hits, 1).select("query_id", "id"), "query_id", "left").select("query_id", "span", F.lit(number).alias("round"), "id")
        held = materialise(found if held is None else held.unionByName(found), "active-held")
    out = confidences()
    if held is None:
        return out.select("query_id", "span", "confidence", F.lit(None).cast("int").alias("round"), F.lit(None).cast(docs.schema["id"].dataType).alias("id"))
    return out.join(held, ["query_id", "span"], "left").select("query_id", "span", "confidence", "round", "id")
