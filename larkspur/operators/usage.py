"""Ledger of model calls: cost, latency and load metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.shared import materialise

# Prices for 1000 tokens.
RATES = {
    "mini": {"in": 0.000150, "out": 0.000600, "batch_in": 0.000075, "batch_out": 0.000300},
    "4o": {"in": 0.002500, "out": 0.010000, "batch_in": 0.001250, "batch_out": 0.005000},
}
EMBEDDING_RATE = 0.000130


def cost(tokens_in: Column, tokens_out: Column, tokens_embedded: Column | None = None, batch: bool = False, model: str = "mini") -> Column:
    rates, prefix = RATES[model], "batch_" if batch else ""
    total = tokens_in / 1000 * rates[f"{prefix}in"] + tokens_out / 1000 * rates[f"{prefix}out"]
    return total if tokens_embedded is None else total + tokens_embedded / 1000 * EMBEDDING_RATE


def by_phase(calls: DataFrame, batch: bool = False) -> DataFrame:
    """Calls (phase, tokens_in, tokens_out, tokens_emb) summed by phase, with cost."""
    sums = calls.groupBy("phase").agg(F.count("*").alias("n_calls"), *[F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "tokens_emb")])
    return sums.withColumn("cost", F.round(cost(F.col("tokens_in"), F.col("tokens_out"), F.col("tokens_emb"), batch), 6))


def by_file(inserts: DataFrame) -> DataFrame:
    """Inserts (file, batch boolean, tokens) by file and in all (file null), with the share of batch calls."""
    share = F.round(100 * F.sum(F.when(F.col("batch"), 1).otherwise(0)) / F.count("*"), 4)
    return inserts.rollup("file").agg(F.count("*").alias("n_calls"), F.sum("tokens").alias("tokens"), share.alias("batch_pct"))


def savings(calls: DataFrame) -> DataFrame:
    """What batch prices save against the same calls in real time."""
    sums = calls.agg(F.sum("tokens_in").alias("i"), F.sum("tokens_out").alias("o"))
    full, half = cost(F.col("i"), F.col("o")), cost(F.col("i"), F.col("o"), batch=True)
    return sums.select(F.round(half, 6).alias("batch_cost"), F.round(full - half, 6).alias("saved"), F.round(100 * (full - half) / full, 4).alias("saved_pct"))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Values at place floor(n * share), from 0, of each group in order, at most the last.

    Values are counted before they are ordered, so a group of many equal values is
    a few rows. They are dealt by range, and each range goes on from the count of the ones before,
    so no task orders a whole group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    ranged = materialise(counts.repartitionByRange(*by, value).withColumn("range", F.spark_partition_id()), "percentile-ranges")
    over = Window.partitionBy(*by)
    earlier = F.coalesce(F.sum("s").over(over.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row a group and range
    sums = ranged.groupBy(*by, "range").agg(F.sum("c").alias("s")).withColumn("earlier", earlier).withColumn("n", F.sum("s").over(over))
    named = sums.select(*[F.col(c).alias(f"of_{c}") for c in (*by, "range")], "earlier", "n")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*by, "range")])
    within = F.sum("c").over(Window.partitionBy(*by, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("within", within).join(named, same).withColumn("upto", F.col("earlier") + F.col("within"))
    place = {k: F.least(F.floor(F.col("n") * s), F.col("n") - 1) for k, s in shares.items()}
    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("upto") > p, F.col(value))).alias(k) for k, p in place.items()])


def load_stats(results: DataFrame, by: list[str]) -> DataFrame:
    """Latencies of successes (error null), totals of all: results (sec, tokens, cost, error)."""
    good = results.where("error is null")
    marks = percentiles(good, by, "sec", {"p50": 0.50, "p95": 0.95, "p99": 0.99})
    base = good.groupBy(*by).agg(F.count("*").alias("n_ok"), F.round(F.avg("sec"), 6).alias("avg_sec"), F.min("sec").alias("min_sec"), F.max("sec").alias("max_sec"))
    every = results.groupBy(*by).agg(F.count("*").alias("n_all"), F.sum("tokens").alias("tokens"))
    return every.join(base, by, "left").join(marks, by, "left")


def histogram(rows: DataFrame, value: str = "sec") -> DataFrame:
    """Rows by whole seconds."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.floor(value).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def by_user(results: DataFrame) -> DataFrame:
    return results.where("error is null").groupBy("user_id").agg(F.count("*").alias("n_ok"), F.round(F.avg("sec"), 6).alias("avg_sec"), F.round(F.sum("cost"), 6).alias("total_cost"))


def winner(a: Column, b: Column) -> Column:
    """The faster of two, if it is by a tenth."""
    return F.when(a < b * 0.9, "A").when(b < a * 0.9, "B").otherwise("-")


def speed_up(a: Column, b: Column) -> Column:
    ratio = a / b
    return F.when(b == 0, "-").when(ratio >= 1.1, F.format_string("B %.1fx", ratio)).when(ratio <= 0.9, F.format_string("A %.1fx", 1 / ratio)).otherwise("=")


def timing_split(calls: DataFrame) -> DataFrame:
    """Per query (query_id, seq, kind, sec): embedding, retrieval (model calls but the last), generation, the rest."""
    last = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.desc("seq"))) == 1
    rows = calls.withColumn("last", (F.col("kind") == "llm") & last)

    def total(condition):
        return F.round(F.coalesce(F.sum(F.when(condition, F.col("sec"))), F.lit(0.0)), 6)

    out = rows.groupBy("query_id").agg(total(F.col("kind") == "emb").alias("emb_sec"), total((F.col("kind") == "llm") & ~F.col("last")).alias("retrieval_sec"), total(F.col("last")).alias("generation_sec"), F.round(F.sum("sec"), 6).alias("all_sec"))
    return out.withColumn("other_sec", F.round(F.greatest(F.lit(0.0), F.col("all_sec") - F.col("emb_sec") - F.col("retrieval_sec") - F.col("generation_sec")), 6))
