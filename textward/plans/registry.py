"""All operator queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import base, data_queries, eval_queries, job_queries, source_queries, text_queries  # noqa: F401  (they register their queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moderation cascade over documents."""
    return base.QUERIES["c11_moderate"](spark, sf_dir)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.SQL)
