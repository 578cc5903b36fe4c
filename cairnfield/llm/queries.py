"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnfield.llm import decontaminate, html, langid, lines, mixing, ppm, sharding, simhash, tokens, toxicity
from cairnfield.llm.common import table


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_quality(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.write_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json"))).documents(spark).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "frame")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(table(spark, sf_dir, "documents"))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op9_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_held_out(table(spark, sf_dir, "documents"))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_quality": op1_line_quality,
    "op2_language_id": op2_language_id,
    "op3_token_files": op3_token_files,
    "op4_toxicity": op4_toxicity,
    "op5_mixing_rates": op5_mixing_rates,
    "op6_simhash_components": op6_simhash_components,
    "op7_benchmark_leaks": op7_benchmark_leaks,
    "op8_sharding": op8_sharding,
    "op9_ppm_scores": op9_ppm_scores,
    "op10_html_main_text": op10_html_main_text,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_quality": lines.LINE_QUALITY_SQL,
    "op8_sharding": sharding.SHARDING_SQL,
}
