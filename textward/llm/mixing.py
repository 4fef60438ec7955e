"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key -ln(u) / w, u a hash of seed, id and text, w its quality weight. Documents of a
source are sorted by key and taken while the prefix sum of their words stays within the source's budget: whole epochs
first (every document once each), then the sorted prefix for what is left.

A source may hold a third of all rows, so no source is sorted as one group: keys fall in 4096 ranges, the ranges are
summed with partial aggregation, and only the one range in which a source's budget ends is sorted, equal rows as one.
What the rest of the job needs is one line per source: epochs, the last key taken, and how many of the equal rows with
this key. Sources themselves are ranked in ranges, and the level of the weights is found by rounds of one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_of, written

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
RANGES = 4096
SALTS = 64
SEED = "mix-1"
#: A table of sources up to this many rows is broadcast; beyond it the join shuffles, skewed sources split by AQE.
BROADCAST_SOURCES = 100_000


def quality_weight(text: Column) -> Column:
    """1 less five times the share of characters in [#*$%&|<>], 0.05 at least: junk gets late keys."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
    return F.greatest(F.lit(0.05), 1.0 - 5.0 * symbols / F.greatest(F.char_length(text), F.lit(1)))


def _keyed(docs: DataFrame, seed: str, carry: list[str]) -> DataFrame:
    text = text_of("text")
    drawn = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        quality_weight(text).alias("weight"),
        F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.md5(text))).alias("draw"),
        *[F.col(f"`{c}`") for c in carry],
    )
    u = (F.conv(F.substring("draw", 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    key = -F.log(u) / F.col("weight")
    return drawn.withColumn("key", key).withColumn("range", F.floor(F.col("key") / (F.col("key") + 1.0) * RANGES).cast("int"))


def ranked(df: DataFrame, by: list, name: str) -> DataFrame:
    """df with its rank from 0 in the order of by, which tells all rows apart: a range of it per task, offsets between them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()), name)
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*by))
    return dealt.withColumn("inside", inside).join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.col("inside") - 1).drop("part", "inside", "offset")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size -> plus target: the weights share all words, no source above cap times its size.

    What is above is shared again by weight until none is above: in each round the sources that reach their cap leave,
    and one aggregation gives the level of the others. Sources are in order of code points, null last.
    """
    ordered = ranked(sizes, [F.col("source").isNull(), F.col("source")], "mix-sources")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    s = ordered.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    level, closed = 0.0, -1
    while True:
        shut = F.col("limit") < F.lit(level) * F.col("w")
        open_w = F.sum(F.when(~shut, F.col("w")))
        every, taken, free, now = s.agg(F.sum("source_size"), F.sum(F.when(shut, F.col("limit"))), open_w, F.count_if(shut)).first()
        if now == closed or not free:
            break
        level, closed = (every - (taken or 0.0)) / free, now
    target = F.least(F.col("limit"), F.lit(level) * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per source: target, epochs, and the key up to which the sorted prefix goes."""
    sums = sized.groupBy("source", "range").agg(F.sum("size").alias("words"))
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = targets(sizes, weights, cap)
    goals = goals.withColumn("epochs", F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)) + 1e-9))
    goals = goals.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    goals = goals.withColumn("src", F.struct("source"))
    running = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = (
        sums.withColumn("src", F.struct("source")).drop("source").join(goals.select("src", "budget"), "src")
        .withColumn("upto", F.sum("words").over(running))
        .where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget")))
        .groupBy("src").agg(F.min("range").alias("range"), F.min_by(F.col("upto") - F.col("words"), "range").alias("before"))
    )
    goals = goals.join(ranges, "src", "left")
    # only the rows of the range in which the budget ends are sorted
    edge = sized.withColumn("src", F.struct("source")).join(
        _small(goals.where("range is not null").select("src", "range", "before", "budget")), ["src", "range"]
    )
    edge = edge.groupBy("src", "key", "draw", "size", "before", "budget").agg(F.count(F.lit(1)).alias("alike"))
    inside = Window.partitionBy("src").orderBy("key", "draw").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum(F.col("size") * F.col("alike")).over(inside) - F.col("size") * F.col("alike")
    # a row is taken while at least half of it is within the budget
    fit = F.when(F.col("size") == 0, F.col("alike")).otherwise(F.floor((F.col("budget") - F.col("start")) / F.col("size") + 0.5))
    taken = edge.withColumn("start", start).withColumn("fit", F.least(F.col("alike"), fit)).where((F.col("fit") > 0) & (F.col("start") <= F.col("budget")))
    last = taken.groupBy("src").agg(F.max(F.struct("key", "draw", "fit", "alike")).alias("last"))
    return goals.join(last, "src", "left").select(
        "src", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), F.coalesce("range", F.lit(RANGES)).alias("edge_range"),
        F.struct("last.key", "last.draw").alias("last"), F.coalesce("last.fit", F.lit(0)).alias("fit"), F.coalesce("last.alike", F.lit(0)).alias("alike"),
    )


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table of sources only after counting it."""
    return F.broadcast(df) if df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else df


def mix(docs: DataFrame, carry: list[str] = (), weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """Every document with how often the mix takes it.

    Returns doc_id, size, source_size, target, taken, copies and the columns in carry. size is the number of words, 0
    for null or blank texts (their taken is 0; they are copied as often as their source has epochs). Null is a source
    of its own, last in order. Repeated rows draw the same key; where the budget ends among them, only as many are taken
    as fit. Very long texts count whole. An empty table gives no rows. A source without words has target 0.
    """
    sized = written(_keyed(docs, seed, []).select("source", "size", "key", "range", "draw"), "mix-sizes")
    lines = written(plan(sized, weights, cap), "mix-plan")
    names = [f"carried_{i}" for i in range(len(carry))]
    inputs = docs.select("doc_id", "source", "text", *[F.col(f"`{c}`").alias(n) for n, c in zip(names, carry)])
    # words and draw are recomputed from the row, so no row-by-row join is needed
    rows = _keyed(inputs, seed, names)
    joined = rows.withColumn("src", F.struct("source")).join(_small(lines), "src")
    mine = F.struct("key", "draw")
    at_last = (F.col("range") == F.col("edge_range")) & F.coalesce(mine == F.col("last"), F.lit(False))
    before = (F.col("range") < F.col("edge_range")) | ((F.col("range") == F.col("edge_range")) & F.coalesce(mine < F.col("last"), F.lit(False)))
    split = lines.where("0 < fit AND fit < alike").limit(1).count() > 0
    if split:
        torn = F.col("fit") < F.col("alike")
        extra = _some_of_alike(joined.where(at_last & torn)).unionByName(joined.where(~(at_last & torn)).withColumn("extra", before | at_last))
    else:
        extra = joined.withColumn("extra", before | at_last)
    capped = F.col("epochs") >= F.lit(int(cap))
    copies = F.col("epochs") + F.when(F.col("extra") & ~capped, 1).otherwise(0)
    return extra.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"),
        *[F.col(n).alias(c) for n, c in zip(names, carry)],
    )


def _some_of_alike(rows: DataFrame) -> DataFrame:
    """Equal rows with extra: true for `fit` of them, counted over SALTS parts of each source's rows."""
    rows = written(rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "mix-alike")
    counts = rows.groupBy("src", "part").agg(F.count(F.lit(1)).alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("src", "part").orderBy("draw"))
    numbered = rows.withColumn("inside", inside).join(_small(counts.withColumn("offset", offset).drop("n")), ["src", "part"])
    return numbered.withColumn("extra", F.col("offset") + F.col("inside") <= F.col("fit")).drop("part", "inside", "offset")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: docs with each row as often as it is taken; same columns. Nulls, ties and repeats as in mix."""
    columns = docs.columns
    wide = docs.select("doc_id", "source", "text", *[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(columns)])
    rows = mix(wide, carry=[f"in_{i}" for i in range(len(columns))])
    rows = rows.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(columns)])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))) AS draw
  FROM documents
), k AS (
  SELECT *, -ln((('0x' || substr(draw, 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
         / greatest(0.05, 1.0 - 5.0 * len(regexp_extract_all(text, '[#*$%&|<>]'))::DOUBLE / greatest(length(text), 1)) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0 * sum(size) AS lim,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM k GROUP BY source
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
  FROM s WINDOW b AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(lim, coalesce(max(CASE WHEN lev <= lim / w THEN lev END) OVER () * w, lim))::DOUBLE AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END AS epochs FROM t
), p AS (
  SELECT k.doc_id, k.size::BIGINT AS size, e.source_size, e.target, e.epochs,
         greatest(0.0, e.target - e.epochs * e.source_size) AS budget,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.draw ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN epochs < 3 AND upto - size / 2.0 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
