"""Running sums over a whole table without putting it on one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def prefix_sum(df: DataFrame, order: str, values: list[str], parts: int | None = None) -> DataFrame:
    """df with run_<value>: the sum of value over all rows whose `order` is at least the row's (descending).

    order must be numeric and distinct per row. Its quantiles (as many as shuffle partitions unless told) cut the table into ranges; the
    ranges' totals, one short row each, become offsets; the running sum is then local to a range.
    """
    parts = parts or max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], max(1000, 20 * parts))).first()[0] or []
    cut = F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges))]).cast("array<double>"), lambda e: e <= F.col(order)))
    cut = cut if edges else F.lit(0)
    df = df.withColumn("cut", cut)
    totals = df.groupBy("cut").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"off_{v}") for v in values])
    above, lines = None, []
    for line in totals.orderBy(F.desc("cut")).collect():  # a row per range
        above = [x - x for x in line[1:]] if above is None else above
        lines.append((line["cut"], *above))
        above = [x + y for x, y in zip(above, line[1:])]
    offsets = df.sparkSession.createDataFrame(lines, StructType([StructField(f.name, f.dataType) for f in totals.schema]), verifySchema=False)
    here = Window.partitionBy("cut").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(F.broadcast(offsets), "cut")  # at most `parts` rows
    return out.select(*df.drop("cut").columns, *[(F.sum(v).over(here) + F.col(f"off_{v}")).alias(f"run_{v}") for v in values])


def prefix_sum_by(df: DataFrame, by: str, order: str, values: list[str], parts: int = 32) -> DataFrame:
    """The same within each group of `by`. Groups must be few, such as features: each has `parts` ranges of its own."""
    bounds = df.groupBy(by).agg(F.array_distinct(F.percentile_approx(order, [k / parts for k in range(1, parts)], 1000)).alias("edges"))
    df = df.join(F.broadcast(bounds), by)  # `parts` numbers a group
    df = df.withColumn("cut", F.size(F.filter("edges", lambda e: e <= F.col(order)))).drop("edges")
    above = Window.partitionBy(by).orderBy(F.col("cut").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(by, "cut").agg(*[F.sum(v).alias(f"sum_{v}") for v in values])
    offsets = totals.select(by, "cut", *[F.coalesce(F.sum(f"sum_{v}").over(above), F.lit(0)).alias(f"off_{v}") for v in values])
    here = Window.partitionBy(by, "cut").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(F.broadcast(offsets), [by, "cut"])  # at most `parts` rows a group
    return out.select(*df.drop("cut").columns, *[(F.sum(v).over(here) + F.col(f"off_{v}")).alias(f"run_{v}") for v in values])
