"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import codebooks, decontaminate, language, mpeg, ngrams, packing, phrases, rollups, simhash, tokenfiles, toxicity, urls, wrappers
from larkspur.shared import shared_path, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_on_fold(docs, table(spark, sf_dir, "labels")))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.describe(mpeg.media_table(table(spark, sf_dir, "documents")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit_on_fold(docs))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngrams.score(docs, ngrams.build_on_fold(docs, keep=1, discount=None))


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = rollups.RollupStore(spark, shared_path(spark, "rollups"))
    for name, changes in rollups.corpus_changes(table(spark, sf_dir, "documents")).items():
        store.commit(name, changes)
        store.commit(name, changes)  # comes again and changes nothing
    return store.totals()


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.tokens_of(table(spark, sf_dir, "documents"), shared_path(spark, "token-files"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_mpeg_media": op5_mpeg_media,
    "op6_language_id": op6_language_id,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_url_filters": op8_url_filters,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_token_rollups": op10_token_rollups,
    "op11_token_files": op11_token_files,
    "op12_phrases": op12_phrases,
    "op13_vector_codes": op13_vector_codes,
}

SQL: dict[str, str] = {
    "op4_benchmark_decontamination": decontaminate.SQL,
    "op8_url_filters": urls.SQL,
    "op10_token_rollups": rollups.SQL,
    "op12_phrases": phrases.SQL,
    "op13_vector_codes": codebooks.SQL,
}
