"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ctw, divergence, exact_dedup, html_text, line_dedup, manifest, mixing, near_dup, ngram_join, quality, tokens, url_rules
from .common import table


def op1_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.strip_repeats(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.group(table(spark, sf_dir, "documents")).drop("best")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


_ALL = (
    op1_ctw_scoring,
    op2_url_filters,
    op3_exact_dedup,
    op4_html_extraction,
    op5_mixing,
    op6_sentencepiece,
    op7_quality_rules,
    op8_line_dedup,
    op9_simhash_near_dedup,
    op10_token_counts,
    op11_source_divergence,
    op12_merkle_manifest,
    op13_ngram_join,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "op2_url_filters": url_rules.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_merkle_manifest": manifest.ORACLE,
}
