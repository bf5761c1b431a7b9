"""Questions taken apart: sub-questions that need each other's answers, answered wave by wave.

Sub-questions are rows (request_id, sub_id, question, needs); ``needs`` names the sub_ids
whose answers stand for {sub_id} in the question. A wave is all sub-questions, of all requests,
whose needs are answered: so a batch of requests takes as many calls of the model or
index as its longest chain is long. Of rows that share both ids the first question counts.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.shared import materialise

PLANNED = "request_id long, sub_id int, wave int, status string"


def planned(subs: DataFrame) -> DataFrame:
    """(request_id, sub_id, wave, status): waves from 1; without one what can never be answered.

    ``missing`` needs, itself or by way of others, a sub-question that is not there; ``cycle``
    needs itself in the end, or another that does.
    """

    def plan(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # a request's own few sub-questions
        needs = {int(s): {int(n) for n in (() if n is None else n)} for s, n in zip(group["sub_id"], group["needs"], strict=True)}
        wave: dict[int, int] = {}
        while ready := [s for s, n in needs.items() if s not in wave and n <= wave.keys()]:
            at = {s: 1 + max((wave[n] for n in needs[s]), default=0) for s in ready}
            wave |= at
        missing: set[int] = set()
        while more := {s for s, n in needs.items() if s not in missing and (n - needs.keys() or n & missing)}:
            missing |= more
        rows = [(key[0], s, wave.get(s), "answered" if s in wave else "missing" if s in missing else "cycle") for s in needs]
        return pd.DataFrame(rows, columns=["request_id", "sub_id", "wave", "status"]).astype({"wave": "Int32"})

    first = subs.groupBy("request_id", "sub_id").agg(F.min_by("needs", "question").alias("needs"))
    return first.groupBy("request_id").applyInPandas(plan, PLANNED)


def answered(subs: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(request_id, sub_id, wave, status, question, answer) of all sub-questions.

    ``answer`` gives rows (request_id, sub_id, answer) for a wave's (request_id, sub_id, question);
    a question it says nothing to has an empty answer. Questions that cannot be answered stay as
    they are, with a null answer.
    """
    plan = materialise(planned(subs), "waves-plan")
    text = subs.groupBy("request_id", "sub_id").agg(F.min_by(F.struct("question", "needs"), "question").alias("s")).select("request_id", "sub_id", "s.*")
    rows = materialise(plan.join(text, ["request_id", "sub_id"]), "waves")
    done = None
    for wave in range(1, (rows.agg(F.max("wave")).first()[0] or 0) + 1):
        now = rows.where(F.col("wave") == wave).select("request_id", "sub_id", "question", "needs")
        if done is not None:
            known = now.select("request_id", "sub_id", F.explode("needs").alias("need")).distinct().join(done.select("request_id", F.col("sub_id").alias("need"), "answer"), ["request_id", "need"])
            given = known.groupBy("request_id", "sub_id").agg(F.array_sort(F.collect_list(F.struct("need", "answer"))).alias("given"))
            bound = F.aggregate(F.coalesce("given", F.array().cast("array<struct<need:int,answer:string>>")), F.col("question"), lambda q, g: F.replace(q, F.concat(F.lit("{"), g["need"].cast("string"), F.lit("}")), g["answer"]))
            now = now.join(given, ["request_id", "sub_id"], "left").select("request_id", "sub_id", bound.alias("question"))
        asked = materialise(now.select("request_id", "sub_id", "question"), "waves-asked")
        said = asked.join(answer(asked).select("request_id", "sub_id", "answer"), ["request_id", "sub_id"], "left")
        said = materialise(said.select("request_id", "sub_id", "question", F.coalesce("answer", F.lit("")).alias("answer")), "waves-answers")
        done = said if done is None else done.unionByName(said)
    if done is None:
        return rows.select("request_id", "sub_id", "wave", "status", "question", F.lit(None).cast("string").alias("answer"))
    said = done.withColumnRenamed("question", "bound")
    return rows.join(said, ["request_id", "sub_id"], "left").select("request_id", "sub_id", "wave", "status", F.coalesce("bound", "question").alias("question"), "answer")
