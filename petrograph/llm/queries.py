"""Registered queries of the training-data operators: opN_<name> and pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from petrograph.llm import chat, divergence, html_extract, line_dedup, mixing, neardup, phrases, pieces, quality, repair, secret_scan, suffix_dedup, topk
from petrograph.llm.common import documents, read_table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.formatted(chat.with_probe(read_table(spark, sf_dir, "conversations"))))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_table(documents(spark, sf_dir))


def op8_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.without_repeats(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(read_table(spark, sf_dir, "pages"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audited(repair.damaged(read_table(spark, sf_dir, "conversations")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.without_common_lines(documents(spark, sf_dir)))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_minhash_near_dedup, op3_suffix_array_dedup, op4_sentencepiece, op5_exact_top_k, op6_mixing, op7_secret_scan, op8_repeated_phrases, op9_quality_rules, op10_html_extraction, op11_structure_repair, op12_line_dedup, op13_source_divergence)}
ORACLE_SQL: dict[str, str] = {"op11_structure_repair": repair.SQL, "op12_line_dedup": line_dedup.SQL, "op13_source_divergence": divergence.SQL}
