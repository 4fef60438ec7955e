"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever their names. In all stages a null text counts
as empty, very long texts are read whole, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textward.llm import exact_dedup, mixing, quality, similar, tokens
from textward.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and blank texts are among them. Repeated rows stay or go together."""
    return quality.keep_good(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space the longest stays, of those the smallest id (null last), of repeated rows one."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with similar five-word shingles (Jaccard 0.8 or more) the smallest id stays, of repeated rows one.

    Candidates come from op9's SimHash links by pivot distance tables, and from MinHash what lies beyond their bits.
    """
    return similar.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; a null source is one of its own, equal rows are taken one by one."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, a row per document, with its source."""
    return tokens.encode(docs, carry=["source"])


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Shingle sets and pieces are beyond SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None
