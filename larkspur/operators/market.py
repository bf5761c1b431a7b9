"""Price series: (ticker, ts, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The periods that can be asked for.
PERIODS = ("1d", "5d", "1mo", "3mo", "6mo", "1y", "2y", "5y")


def checked(tickers: list[str], period: str) -> str | None:
    """What is wrong with a comparison request, if anything is."""
    if period not in PERIODS:
        return f"unknown period {period}: one of {', '.join(PERIODS)}"
    return None if 2 <= len(tickers) <= 5 else "two to five tickers can be compared"


def summary(prices: DataFrame) -> DataFrame:
    """First and last close, return, extremes and mean volume of each ticker."""
    out = prices.groupBy("ticker").agg(F.min_by("close", "ts").alias("first_close"), F.max_by("close", "ts").alias("last_close"), F.max("high").alias("max_high"), F.min("low").alias("min_low"), F.round(F.avg("volume"), 4).alias("avg_volume"))
    return out.withColumn("return_pct", F.round(100 * (F.col("last_close") - F.col("first_close")) / F.col("first_close"), 4))


def last_rows(prices: DataFrame, n: int = 5) -> DataFrame:
    order = Window.partitionBy("ticker").orderBy(F.desc("ts"))
    return prices.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def changes(prices: DataFrame) -> DataFrame:
    """Change against the close before, in all and in percent."""
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("ts"))
    rows = prices.withColumn("previous", before)
    return rows.select("ticker", "ts", "close", F.round(F.col("close") - F.col("previous"), 4).alias("change"), F.round(100 * (F.col("close") - F.col("previous")) / F.col("previous"), 4).alias("change_pct"))


def history(prices: DataFrame, period: str) -> DataFrame:
    """Rows of each ticker within a period before its last one."""
    if period not in PERIODS:
        raise ValueError(checked(["a", "b"], period))
    n, unit = int("".join(c for c in period if c.isdigit())), period.lstrip("0123456789")
    span = F.expr(f"interval {n} {({'d': 'days', 'mo': 'months', 'y': 'years'})[unit]}")
    last = F.max("ts").over(Window.partitionBy("ticker"))
    return prices.withColumn("last", last).where(F.col("ts") > F.col("last") - span).drop("last")


def described(prices: DataFrame) -> DataFrame:
    """(ticker, line): last close, its change and the return of a ticker, as an agent says them."""
    latest = changes(prices).groupBy("ticker").agg(F.max_by("change_pct", "ts").alias("change_pct"))
    rows = summary(prices).join(latest, "ticker", "left")
    return rows.select("ticker", F.concat("ticker", F.lit(": "), F.format_string("%.2f", "last_close"), F.lit(" ("), F.coalesce(F.format_string("%+.2f%%", "change_pct"), F.lit("N/A")), F.lit("), return "), F.format_string("%.2f%%", "return_pct")).alias("line"))
