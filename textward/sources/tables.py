"""Reading corpora and reports, and writing splits, reports and keyed tables (S)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import require
from ..operators.relational import upsert
from .scratch import scratch  # noqa: F401

# The columns of a run's summary row, in order; below, the part of the run that they come from.
ROW = [
    "timestamp", "git_commit", "run_tag", "mode", "target_rate", "achieved_throughput", "throughput_steady", "throughput_overall", "e2e_p50", "e2e_p95", "e2e_p99", "e2e_p999", "e2e_max",
    "intended_p50", "intended_p95", "intended_p99", "intended_p999", "intended_max", "single_server_p50", "single_server_p95", "single_server_p99", "success_rate", "cache_hit_rate", "n_items",
    "batch_size", "batch_window", "send_workers", "backend_replicas", "pool_workers", "prefetch", "model_tox", "model_spam", "note",
]
RUN, METRICS = ROW[:3], ROW[5:24]
CONDITIONS = [*ROW[3:5], *ROW[24:32]]
_TEXTS = {"mode", "model_tox", "model_spam"}


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """text, label of a CSV or Parquet corpus, by the suffix of its path; of Parquet only these two columns are read."""
    if path.rstrip("/").lower().endswith(".csv"):
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    elif path.rstrip("/").lower().endswith(".parquet"):
        rows = spark.read.parquet(path)
    else:
        raise ValueError(f"{path}: a corpus is .csv or .parquet")
    return require(rows, ["text", "label"]).select("text", "label")


def read_corpus(spark: SparkSession, data: str | None = None, train: str | None = None, val: str | None = None) -> tuple[DataFrame, DataFrame | None, bool]:
    """(train, val, False) of a pair of Parquet tables; (data, None, True) of one, to be cross-validated; else ValueError."""
    if train is not None and val is not None:
        return spark.read.parquet(train), spark.read.parquet(val), False
    if data is None:
        raise ValueError("name one table, or a train and a val table")
    return spark.read.parquet(data), None, True


def write_splits(df: DataFrame, path: str, part: str = "part") -> None:
    """A Parquet folder per part (train, val, test), from one pass over df."""
    df.write.mode("overwrite").partitionBy(part).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, so texts with quotes and line ends come back whole."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def run_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """A summary row per run, from its JSON: known conditions and metrics in the fixed order of ROW; what lacks is null."""
    field = lambda c: f"{c} {'string' if c in _TEXTS else 'double'}"
    inner = lambda names: "struct<" + ", ".join(field(c).replace(" ", ": ") for c in names) + ">"
    schema = ", ".join([*(f"{c} string" for c in RUN), f"conditions {inner(CONDITIONS)}", f"metrics {inner(METRICS)}", "note string"])
    run = lines.select(F.from_json(column, schema).alias("run"))
    place = {c: "run.conditions." for c in CONDITIONS} | {c: "run.metrics." for c in METRICS}
    return run.select(*[F.col(place.get(c, "run.") + c).alias(c) for c in ROW])


def append_rows(rows: DataFrame, path: str) -> None:
    """Adds summary rows to the CSV table of runs."""
    rows.write.mode("append").option("header", True).option("escape", '"').csv(path)


def save_verdicts(updates: DataFrame, table: str, batch: int, keys: list[str], version: str, buckets: int = 64) -> DataFrame:
    """Upserts a batch into a keyed Parquet table and returns the new state; for foreachBatch.

    The table lies in buckets by hash of the key. A batch writes only the buckets it has keys in, as version=<batch> from
    their latest version before it, so a replayed batch makes the same table again and other buckets are not touched.
    """
    spark = updates.sparkSession
    rows = updates.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # `buckets` numbers at most
    current = verdict_table(spark, table, updates, before=batch, only=touched)
    new = upsert(current, updates, keys, version).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/version={batch}")
    return verdict_table(spark, table, updates, before=batch + 1)


def verdict_table(spark: SparkSession, table: str, like: DataFrame, before: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of a keyed table: of each bucket the latest complete version (before a batch)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    path = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join([table, *parts]))
    listed = lambda p: [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    done = sorted(int(n.split("=")[1]) for n in listed(root) if n.startswith("version=") and fs.exists(path(n, "_SUCCESS")))
    latest: dict[int, str] = {}
    for v in done:
        if before is None or v < before:
            for n in listed(path(f"version={v}")):
                if n.startswith("bucket="):
                    latest[int(n.split("=")[1])] = f"{table}/version={v}/{n}"
    folders = [p for b, p in sorted(latest.items()) if only is None or b in only]
    return spark.read.schema(like.schema).parquet(*folders) if folders else like.limit(0)


def save_cache(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Adds verdicts (key, verdict, cached_at, ttl_s) to a cache that lies by hour of expiry and bucket of the key.

    A key may be there again (a newer verdict, or a batch that was written twice); lookups take the latest.
    """
    until = F.unix_timestamp(F.col("cached_at").cast("timestamp")) + F.col("ttl_s")
    rows = rows.withColumns({"hour": F.floor(until / 3600), "bucket": F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")})
    rows.repartition("hour", "bucket").write.mode("append").partitionBy("hour", "bucket").parquet(path)


def cached(spark: SparkSession, path: str, items: DataFrame, now: datetime, buckets: int = 64) -> DataFrame:
    """The part of a cache that a batch of items (key) can hit: hours that are not over, buckets that it has keys in."""
    own = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    asked = [r["bucket"] for r in items.select(own).distinct().collect()]  # `buckets` numbers at most
    rows = spark.read.parquet(path)
    return rows.where((F.col("hour") >= int(now.timestamp()) // 3600) & F.col("bucket").isin(asked)).drop("hour", "bucket")


def drop_expired(spark: SparkSession, path: str, now: datetime) -> list[int]:
    """Removes the hours of a cache that are over, and tells which."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(root)]
    gone = sorted(int(n.split("=")[1]) for n in names if n.startswith("hour=") and int(n.split("=")[1]) < int(now.timestamp()) // 3600)
    for hour in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/hour={hour}"), True)
    return gone
