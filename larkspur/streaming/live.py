"""Structured Streaming forms of the operators that take a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_rollup(calls: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Calls (ts, phase, tokens) by event-time window and phase; state is dropped behind the watermark."""
    return calls.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), "phase").agg(F.count("*").alias("n_calls"), F.sum("tokens").alias("tokens"))


def fresh(entries: DataFrame, keys: list[str], lateness: str = "24 hours") -> DataFrame:
    """The first entry of each key within the time that entries live."""
    return entries.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions of events (ts, user_id), closed by a gap."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n_events"))
