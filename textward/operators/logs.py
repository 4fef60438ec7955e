"""Timing logs: lines to typed events, and what is told of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _part(name: str, kind: str = "[^ ]+") -> Column:
    return F.regexp_extract("line", rf"(?:^| ){name}=({kind})", 1)


def timing_lines(lines: DataFrame, key: str = "event_id") -> DataFrame:
    """Typed events of timing lines (key, line); fields that a line lacks are null."""
    return lines.select(
        key, _part("component").alias("component"), _part("stage").alias("stage"), _part("event").alias("event"), _part("task").try_cast("long").alias("task"), _part("n").try_cast("long").alias("n"),
        _part("ms", "[0-9.]+").try_cast("double").alias("ms"), _part("hits", "[0-9]+").try_cast("long").alias("hits"), F.nullif(_part("path"), F.lit("")).alias("path"),
    )


def classify_lines(lines: DataFrame, key: str = "event_id") -> DataFrame:
    """Typed events of classification lines; a side that did not run has no time."""
    ms = lambda name: _part(name, "[0-9.]+").try_cast("double").alias(name)
    return lines.select(key, _part("mode").alias("mode"), _part("executor").alias("executor"), _part("items").try_cast("long").alias("items"), ms("wall_ms"), ms("tox_ms"), ms("spam_ms"))


def classify_stats(events: DataFrame) -> DataFrame:
    """Of each executor how many batches, the slower side's mean and largest time, mean wall time, and the modes seen."""
    slower = F.greatest(F.coalesce("tox_ms", F.lit(0.0)), F.coalesce("spam_ms", F.lit(0.0)))
    return events.groupBy("executor").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(slower), 6).alias("slower"), F.round(F.max(slower), 6).alias("most"), F.round(F.avg("wall_ms"), 6).alias("wall"), F.array_join(F.sort_array(F.collect_set("mode")), ",").alias("modes")
    )


def sweep_curve(points: DataFrame, measures: list[str]) -> DataFrame:
    """A row per offered rate: how many repeats it had, and the median over them of each measure."""
    return points.groupBy("offered").agg(F.count(F.lit(1)).alias("repeats"), *[F.round(F.percentile(m, 0.5), 6).alias(m) for m in measures])
