"""Model calls in batches, in two phases: requests are written, answers are joined when they are there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.sources import sinks

# States in which a batch ends.
DONE, LOST = "completed", ("failed", "expired", "cancelled")


def submitted(prompts: DataFrame, path: str, model: str) -> DataFrame:
    """Writes the requests of prompts (i, prompt) and what leads back from their ids to the prompts' hashes."""
    sinks.batch_requests(prompts.select("i", "prompt"), model).write.mode("overwrite").text(f"{path}/requests")
    ids = prompts.select(F.concat(F.lit("chunk-"), F.col("i").cast("string")).alias("custom_id"), F.md5("prompt").alias("hash"))
    ids.write.mode("overwrite").parquet(f"{path}/ids")
    return prompts.sparkSession.read.parquet(f"{path}/ids")


def state(status: str) -> str:
    """What to do with a batch of a given status: collect, give up, or wait."""
    return "collect" if status == DONE else "give up" if status in LOST else "wait"


def polled(batch_id: str, status: Callable[[str], str], tries: int, pause: Callable[[], None] = lambda: None) -> str:
    """Asks for a batch until it ends, at most ``tries`` times; the last thing to do."""
    for _ in range(tries):
        if (then := state(status(batch_id))) != "wait":
            return then
        pause()
    return "wait"


def remapped(ids: DataFrame, results: DataFrame) -> DataFrame:
    """(hash, response) of results (custom_id, response) by the ids (custom_id, hash) that were sent; others are left out."""
    return ids.join(results.select("custom_id", "response"), "custom_id").select("hash", "response")


def resumed(path: str, lines: DataFrame) -> DataFrame:
    """(hash, response) of a submitted batch from its result lines (value)."""
    read = sinks.batch_results(lines)
    results = read.select(F.concat(F.lit("chunk-"), F.col("i").cast("string")).alias("custom_id"), F.col("content").alias("response"))
    return remapped(lines.sparkSession.read.parquet(f"{path}/ids"), results)


def fanned_out(requests: DataFrame, tools: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(tool, ...): what each tool makes of the requests, as one plan, so that all run side by side."""
    out = None
    for name, tool in tools.items():
        part = tool(requests).withColumn("tool", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
