"""Ordered computations: concurrency, micro-batches, length buckets, padding."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .corpus import rank_within
from .metrics import selected

#: Rows of a block of micro-batches, and maps that are composed at once.
BLOCK_ROWS = 100_000
FAN = 64


def peak_concurrency(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Per group the most intervals open at once; ends come before starts of the same instant.

    Moves are sorted by ranges of (group, time). A range gives two numbers per group, its sum and its largest prefix, and
    these merge in order of the ranges, so no group is walked in one task.
    """
    moves = df.select(group, F.inline(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("delta")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("delta")))))
    net = moves.groupBy(group, "at").agg(F.sum("delta").alias("net"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = net.repartitionByRange(parts, group, "at").withColumn("range", F.spark_partition_id())
    inside = F.sum("net").over(Window.partitionBy(group, "range").orderBy("at"))
    ranges = dealt.withColumn("open", inside).groupBy(group, "range").agg(F.sum("net").alias("sum"), F.max("open").alias("highest"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranges.withColumn("peak", before + F.col("highest")).groupBy(group).agg(F.max("peak").cast("long").alias("peak"))


def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with place (from 0, by order) within its group: sorted by ranges and written, then counted from the ranges before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(df.sparkSession, "placed")
    df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumns({"_range": F.shiftright("_at", 33), "_own": F.struct(group)})
    spans = rows.groupBy("_own", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    spans = spans.withColumn("_before", F.sum("_n").over(Window.partitionBy("_own").orderBy("_range")) - F.col("_n")).drop("_n")
    return rows.join(spans, ["_own", "_range"]).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).select(*df.columns, "place")


def _next_starts(times: np.ndarray, size: int, window: int) -> np.ndarray:
    """For each row the place of the row that starts the next batch, if it starts one itself."""
    ages = np.searchsorted(times, times + window, side="left")
    return np.minimum(np.minimum(np.arange(len(times)) + size, ages + 1), len(times))


def _batch_map(size: int, window: int, block: int):
    """The map of a block of rows: from where a batch starts in it (0 to size - 1) to where one starts in the next block, and how many start between."""

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        own = int(np.count_nonzero(rows.column("place").to_numpy() < (key[1].as_py() + 1) * block))
        to, count = _next_starts(rows.column("at").to_numpy(), size, window)[:own], np.ones(own, dtype=np.int64)
        while np.any(to < own):  # each round doubles the steps taken
            inside = np.flatnonzero(to < own)
            at = to[inside]
            count[inside], to[inside] = count[inside] + count[at], to[at]
        leave, started = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        leave[: min(size, own)], started[: min(size, own)] = to[:size] - own, count[:size]
        return pa.table({rows.column_names[0]: pa.array([key[0].as_py()], rows.schema.field(0).type), "block": [key[1].as_py()], "leave": [leave.tolist()], "started": [started.tolist()]})

    return work


def _composed(key: tuple, maps: pa.Table) -> pa.Table:
    """The map of several neighbouring blocks."""
    maps = maps.sort_by("block")
    at = started = None
    for leave, count in zip(maps.column("leave").to_pylist(), maps.column("started").to_pylist()):
        leave, count = np.array(leave), np.array(count)
        at, started = (leave, count) if at is None else (leave[at], started + count[at])
    return pa.table({maps.column_names[0]: pa.array([key[0].as_py()], maps.schema.field(0).type), "block": [key[1].as_py()], "leave": [at.tolist()], "started": [started.tolist()]})


def _entered(key: tuple, maps: pa.Table) -> pa.Table:
    """Where the first batch of each of several neighbouring blocks starts, and its number, from those of all of them (entry, first)."""
    maps = maps.sort_by("block")
    entry, first = maps.column("entry")[0].as_py(), maps.column("first")[0].as_py()
    entries, firsts = [], []
    for leave, count in zip(maps.column("leave").to_pylist(), maps.column("started").to_pylist()):
        entries.append(entry)
        firsts.append(first)
        entry, first = leave[entry], first + count[entry]
    return pa.table({maps.column_names[0]: maps.column(0), "block": maps.column("block"), "entry": entries, "first": firsts})


def _batched(size: int, window: int, block: int):
    """The batch of each row of a block, given where its first batch starts (entry) and that batch's number (first)."""

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        own = int(np.count_nonzero(rows.column("place").to_numpy() < (key[1].as_py() + 1) * block))
        after, starts = _next_starts(rows.column("at").to_numpy(), size, window).tolist(), []
        at = rows.column("entry")[0].as_py()
        while at < own:
            starts.append(at)
            at = after[at]
        batch = rows.column("first")[0].as_py() + np.searchsorted(np.array(starts), np.arange(own), side="right") - 1
        rows = rows.slice(0, own)
        return pa.table({rows.column_names[0]: rows.column(0), rows.column_names[1]: rows.column(1), "batch": batch})

    return work


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """a joined with b on columns of which null is a value like any other."""
    b = b.select(*[F.col(n).alias(f"_{n}") if n in names else F.col(n) for n in b.columns])
    return a.join(b, reduce(and_, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])).drop(*[f"_{n}" for n in names])


def micro_batches(df: DataFrame, source: str, at: str, key: str, size: int, seconds: float, block: int = BLOCK_ROWS) -> DataFrame:
    """source, key, batch: a batch closes with its `size`th item, or with the item that comes `seconds` or more after its first.

    Whoever starts a batch tells who starts the next. Rows of a source are cut into blocks; a block is a map from the place
    where a batch starts in it to the place where one starts in the next. Maps compose, FAN at a time up to one a source;
    on the way back each block learns where its first batch starts, and numbers its rows. Times count to the microsecond.
    """
    spark, block, window = df.sparkSession, max(block, size), round(seconds * 1e6)
    rows = placed(df.select(source, key, F.round(F.col(at).cast("double") * 1e6).cast("long").alias("at")), source, ["at", key])
    rows = rows.withColumn("block", F.floor(F.col("place") / block))
    ahead = rows.where((F.col("place") >= block) & (F.col("place") % block < size)).withColumn("block", F.col("block") - 1)
    rows = rows.union(ahead)
    kind = dict(rows.dtypes)[source]
    most = rows.agg(F.max("block")).first()[0] or 0
    entries = rows.select(source).distinct().withColumns({"block": F.lit(0).cast("long"), "entry": F.lit(0).cast("long"), "first": F.lit(0).cast("long")})
    if most:
        shape = f"{source} {kind}, block long, leave array<long>, started array<long>"
        maps = [rows.groupBy(source, "block").applyInArrow(_batch_map(size, window, block), shape)]
        while True:
            path = scratch(spark, "maps")
            maps[-1].write.parquet(path)
            maps[-1] = spark.read.schema(shape).parquet(path)
            if not most:
                break
            most //= FAN
            above = maps[-1].select(source, F.floor(F.col("block") / FAN).alias("above"), "block", "leave", "started")
            maps.append(above.groupBy(source, "above").applyInArrow(_composed, shape))
        for level in reversed(maps[:-1]):
            above = entries.withColumnRenamed("block", "above")
            inside = _same(level.withColumn("above", F.floor(F.col("block") / FAN)), above, [source, "above"]).select(source, "above", "block", "leave", "started", "entry", "first")
            entries = inside.groupBy(source, "above").applyInArrow(_entered, f"{source} {kind}, block long, entry long, first long")
    rows = _same(rows, entries, [source, "block"]).select(source, key, "block", "place", "at", "entry", "first")
    return rows.groupBy(source, "block").applyInArrow(_batched(size, window, block), f"{source} {kind}, {key} {dict(rows.dtypes)[key]}, batch long")


def linear_bucket(value, least: float, most: float, n: int):
    """The number of upper edges at or below the value, between 0 and n-1."""
    width = (most - least) / n
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((value - least) / width))).cast("int")


def quantile_edges(df: DataFrame, value: str, n: int) -> list[int]:
    """n-1 strictly increasing edges at the quantiles, rounded half to even."""
    found = {r["share"]: r["value"] for r in selected(df, [], F.col(value), tuple(k / n for k in range(1, n))).collect()}  # n - 1 rows
    edges: list[int] = []
    for share in sorted(found):
        e = round(found[share])
        edges.append(max(e, edges[-1] + 1) if edges else e)
    return edges


def length_groups(df: DataFrame, group: str, length: Column, key: str, n: int) -> DataFrame:
    """df with part 1 to n: rows of a group in order of length and key, cut to n parts of nearly equal size, longer parts first."""
    ranked = rank_within(df.withColumn("_length", length), group, F.col("_length"), ["_length", key])
    size, more = F.floor(F.col("all") / n), F.col("all") % n
    whole = (size + 1) * more
    part = F.when(F.col("rank") < whole, F.floor(F.col("rank") / (size + 1))).otherwise(more + F.floor((F.col("rank") - whole) / F.greatest(size, F.lit(1))))
    return ranked.withColumn("part", (part + 1).cast("long")).drop("_length", "rank", "all")


def bucket_batches(df: DataFrame, bucket: str, key: str, size: int, seed: str, epoch: int = 1, drop_last: bool = False) -> DataFrame:
    """df with batch (rows of a bucket in hash order of the epoch, cut into batches) and turn, a draw by which batches are ordered.

    drop_last leaves out batches that are not full. Each epoch shuffles rows and batches anew.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}-{epoch}" if epoch != 1 else seed), F.col(key).cast("string")))
    ranked = rank_within(df.withColumn("_draw", draw), bucket, F.conv(F.substring("_draw", 1, 3), 16, 10).cast("int"), ["_draw", key])
    out = ranked.withColumn("batch", F.floor(F.col("rank") / size))
    if drop_last:
        out = out.where((F.col("batch") + 1) * size <= F.col("all"))
    turn = F.md5(F.concat_ws("|", F.lit(f"{seed}-{epoch}-turn"), F.col(bucket).cast("string"), F.col("batch").cast("string")))
    return out.withColumn("turn", turn).drop("_draw", "rank", "all")


def padding(df: DataFrame, batch: list[str], length: str) -> DataFrame:
    """df with pad: the longest of its batch less its own length, which counts as 1 at least."""
    own = F.greatest(F.col(length), F.lit(1))
    return df.withColumn("pad", F.max(own).over(Window.partitionBy(*batch)) - own)
