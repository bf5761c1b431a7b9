"""The question-answering loop: cache, route, expand, retrieve, fuse, answer, verify, correct, store.

Requests are rows; every step is one plan over all open requests. The only loop is
the bounded correction of answers that were not grounded. Every model is a plug-in with
an offline default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import models
from larkspur.functions.text import fenced
from larkspur.operators import cache, fusion, history, lexical, market
from larkspur.shared import materialise

ROUTES = ("rag", "stock")
COLUMNS = ("request_id", "query", "route", "answer", "corrections", "grounded")
#: Words that send a question to the price table, for the offline router.
STOCK_WORDS = ("stock", "price", "ticker", "주가", "주식")
NO_STOCK = "no price is known"


def routed(label):
    """A route that exists; anything else is rag."""
    clean = F.lower(F.trim(label))
    return F.when(clean.isin(*ROUTES), clean).otherwise("rag")


def word_router(questions: list[str]) -> list[str]:
    """The offline router: stock if the question begins with one of its words."""
    return ["stock" if (q or "").lower().startswith(STOCK_WORDS) else "rag" for q in questions]


def variants(query, answer, most: int = 3):
    """The query and up to three variants out of a model's fenced JSON; the query alone if it cannot be read."""
    found = F.from_json(fenced(answer), "array<string>")
    return F.concat(F.array(query), F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, most))


def verdict(answer):
    """Whether a verdict says grounded; one that cannot be read does."""
    said = F.get_json_object(fenced(answer), "$.verdict")
    return F.coalesce(F.lower(F.trim(said)) == "grounded", F.lit(True))


def words_of(query):
    """An offline variant of a query: its longer words."""
    return F.to_json(F.array(F.array_join(F.filter(F.split(query, r"\s+"), lambda w: F.length(w) > 4), " ")))


def stock_answers(requests: DataFrame, prices: DataFrame | None) -> DataFrame:
    """(request_id, answer) of requests (request_id, query): a line a ticker that the question names, in order."""
    asked = requests.select("request_id", "query")
    if prices is None:
        return asked.select("request_id", F.lit(NO_STOCK).alias("answer"))
    lines = market.described(prices)
    names = history.detected(asked.select(F.col("request_id").alias("id"), F.col("query").alias("text")), lines.select(F.lit("ticker").alias("kind"), F.col("ticker").alias("name")))
    named = names.select(F.col("id").alias("request_id"), F.explode("names").alias("ticker")).join(lines, "ticker")
    told = named.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ticker", "line"))), lambda r: r["line"]), "\n").alias("answer"))
    return asked.select("request_id").join(told, "request_id", "left").select("request_id", F.coalesce("answer", F.lit(NO_STOCK)).alias("answer"))


def answered(
    requests: DataFrame, docs: DataFrame, generator: models.Generator | None = None, k: int = 5, corrections: int = 2, least: float = 0.15,
    cached: DataFrame | None = None, threshold: float = 0.85, embedder: models.Embedder | None = None, prices: DataFrame | None = None,
    router: models.Generator | None = None, checker: models.Generator | None = None, corrector: models.Generator | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(answers, cache entries) of requests (request_id, query) over docs (id, text, source).

    Requests that ``cached`` (id, vector, answer) answers end there. The router sends
    the rest to the price table or to the documents. An answer is grounded if the checker says so, by default if it
    shares enough words with its context; without any document it is taken as it is.
    After ``corrections`` tries, each with the corrector's question, the last answer
    stands. Entries (id, query, vector, answer) are what a later call may be given as
    ``cached``: of answers that were made, with a footer.
    """
    write = generator or models.template_generator()
    asked = materialise(requests.select("request_id", "query").withColumn("vector", models.embedded(F.col("query"), embedder)), "agent-requests")
    done = []

    def ended(rows: DataFrame, route: str) -> DataFrame:
        return rows.select("request_id", "query", F.lit(route).alias("route"), "answer", F.lit(0).alias("corrections"), F.lit(True).alias("grounded"))

    if cached is not None:
        hits = cache.lookup(asked, cached, threshold).where("hit").select("request_id", "answer")
        hits = materialise(asked.select("request_id", "query").join(hits, "request_id"), "agent-hits")
        done.append(ended(hits, "cache"))
        asked = asked.join(hits.select("request_id"), "request_id", "left_anti")
    asked = materialise(asked.withColumn("route", routed(models.generated(F.col("query"), router or word_router))), "agent-routes")
    stock = asked.where("route = 'stock'")
    if not stock.isEmpty():
        done.append(ended(stock.join(stock_answers(stock, prices), "request_id"), "stock"))
    open_ = asked.where("route = 'rag'").select("request_id", "query", F.col("query").alias("asked"))
    index = None
    for attempt in range(corrections + 1):
        expanded = open_.select("request_id", F.posexplode(variants(F.col("asked"), words_of(F.col("asked")))).alias("list_id", "query"))
        keyed = expanded.select((F.col("request_id") * 10 + F.col("list_id")).alias("query_id"), "query")
        if index is None or not index.answers(keyed):
            index = lexical.index(docs, keyed)
        hits = lexical.search(index, keyed, k).select(F.floor(F.col("query_id") / 10).cast("long").alias("query_id"), (F.col("query_id") % 10).alias("list_id"), "rank", "id")
        top = lexical.with_documents(fusion.reciprocal_rank(hits, k), docs.select("id", F.col("source").alias("title"), "text"))
        packed = fusion.context(top, ["query_id"], ["position"]).withColumnRenamed("query_id", "request_id")
        rows = open_.join(packed, "request_id", "left")
        prompt = F.coalesce("context", F.lit(fusion.EMPTY_CONTEXT))
        rows = rows.withColumn("answer", models.generated(prompt, write))
        if checker is None:
            good = F.coalesce(models.scored(F.col("answer"), prompt), F.lit(0.0)) >= least
        else:
            good = verdict(models.generated(F.concat(prompt, F.lit("\n\n"), F.coalesce("answer", F.lit(""))), checker))
        grounded = F.col("context").isNull() | good
        rows = materialise(rows.withColumn("grounded", grounded).withColumn("corrections", F.lit(attempt)).withColumn("route", F.lit("rag")), "agent")
        done.append((rows if attempt == corrections else rows.where("grounded")).select(*COLUMNS))
        again = F.concat_ws(" ", "query", "asked")
        if corrector is not None:
            again = F.coalesce(F.nullif(F.trim(models.generated(F.col("asked"), corrector)), F.lit("")), again)
        open_ = rows.where("not grounded").select("request_id", "query", again.alias("asked"))
        if attempt < corrections:
            open_ = materialise(open_, "agent-open")
            if open_.isEmpty():
                break
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    footed = F.concat(F.coalesce("answer", F.lit("")), F.lit("\n\n(corrections: "), F.col("corrections").cast("string"), F.lit(")"))
    entries = every.where("route <> 'cache'").select(F.xxhash64("query").alias("id"), "query", models.embedded(F.col("query"), embedder).alias("vector"), footed.alias("answer"))
    return every, entries
