"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.llm import (
    chat_format,
    conversation_repair,
    decontaminate,
    exact_search,
    language,
    near_copies,
    near_vectors,
    packing,
    ranked_search,
    repeated_bytes,
    repeated_lines,
    token_files,
    url_rules,
)
from chronicle.llm.frames import table
from chronicle.llm.oracles import ORACLES


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.deduplicated(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.grouped(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.formatted(table(spark, sf_dir, "conversations"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.grouped(table(spark, sf_dir, "embeddings"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.digest(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(conversation_repair.damaged(table(spark, sf_dir, "conversations")), gone="gone")


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_k(table(spark, sf_dir, "embeddings"), F.col("_key") % 100 == 0)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_language_id,
    op2_suffix_dedup,
    op3_simhash,
    op4_decontaminate,
    op5_chat_format,
    op6_near_vectors,
    op7_url_rules,
    op8_best_fit_packing,
    op9_line_dedup,
    op10_token_files,
    op11_conversation_repair,
    op12_exact_top_k,
    op13_ranked_search,
)
QUERIES = {f.__name__: f for f in _ALL}
__all__ = ["ORACLES", "QUERIES"]
