"""From raw documents to packed training sequences, one stage after another.

Every stage works on all that its predecessor kept. Models are fitted on what the
stage is given, as for the operators alone: language and toxicity on the rows
outside their held-out folds.

All stages take whole texts of any length. All but the last give back rows as they came, with all
columns, whatever their names; an empty table stays empty. Null and empty texts have no letter
and go in the first stage; each stage alone treats them as its function says. Equal rows stay or
go alike but in near-dedup, where one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontaminate, language, packing, simhash, toxicity
from larkspur.shared import materialise, table


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones, too) and texts that resemble no learned language."""
    return language.accepted(docs, language.fit_on_fold(docs))


def without_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; a null text is scored like an empty one. Without labels none goes."""
    return toxicity.accepted(docs, toxicity.fit_on_fold(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies; null and empty texts are one group, rows without doc_id stay."""
    return simhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null texts hold none, and an empty benchmark is in no document."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens; a null text is one end id, equal rows are packed as often as they occur."""
    return packing.pack(docs)


STAGES = [
    ("language", known_languages),
    ("toxicity", without_toxicity),
    ("near-dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Tokenisation, suffix automata and fitted models have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``, each reading what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
