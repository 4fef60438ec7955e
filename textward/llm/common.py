"""What the corpus operators share: white space, shared storage, hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of all contracts, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) a temporary folder is set; on a cluster it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def hot_values(df: DataFrame, column: str, parts: int = 1000, least: int = 1000) -> list[str]:
    """The values that hold more than one in `parts` rows, `least` rows at least: so fewer than `parts` values."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows_of_value"))
    bound = max(least, df.count() // parts)
    return [r[0] for r in counts.where(F.col("rows_of_value") > bound).collect() if r[0] is not None]


def salt(column: Column, hot: list[str], key: Column, salts: int) -> Column:
    """A salt from 0 to salts-1, drawn from the key, for hot values; 0 for all others."""
    if not hot:
        return F.lit(0)
    return F.when(column.isin(hot), F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).otherwise(0)


def all_salts(column: Column, hot: list[str], salts: int) -> Column:
    """The array of salts over which the other side of a salted join repeats a row."""
    if not hot:
        return F.array(F.lit(0))
    return F.when(column.isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
