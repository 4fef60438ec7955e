"""Rule mining on a histogram of what rules hit: one scan of the corpus, then a row for each set of rules that hit together.

Sets are masks of up to MAX_MASK patterns, searched in the JVM, or arrays of names from a table of rules of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.scratch import scratch
from . import rule_table
from .metrics import ratio

#: Bits of a mask, and patterns of which all subsets are formed.
MAX_MASK, MAX_SUBSETS = 62, 16


def histogram(df: DataFrame, patterns: dict[str, str], text: str = "text", label: str = "label") -> DataFrame:
    """mask, label, n."""
    if len(patterns) > MAX_MASK:
        raise ValueError(f"{len(patterns)} patterns; masks hold {MAX_MASK}, use histogram_of_rules")
    return df.groupBy(rules.mask(F.col(text), patterns).alias("mask"), F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def bits(patterns: dict[str, str]) -> list[tuple[str, int]]:
    return [(name, 1 << k) for k, name in enumerate(patterns)]


def histogram_of_rules(df: DataFrame, table: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """hits (names of a table's rules), label, n."""
    rows = rule_table.matched(df.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label")), table)
    return rows.groupBy("hits", "label").agg(F.count(F.lit(1)).alias("n"))


def named(hist: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """A histogram with hits in place of the mask."""
    if "hits" in hist.columns:
        return hist
    own = F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(b)) != 0, F.lit(n)) for n, b in bits(patterns)])
    return hist.withColumn("hits", F.filter(own, lambda x: x.isNotNull())).drop("mask")


def _per_hit(hist: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """pattern, label, n, alone of every hit, and a row without hits for each pattern; positives on all rows."""
    hist = named(hist, patterns)
    spark = hist.sparkSession
    own = hist.select(F.explode("hits").alias("pattern"), "label", "n", (F.size("hits") == 1).alias("alone"))
    every = spark.createDataFrame([(name,) for name in patterns], "pattern string").select("pattern", F.lit(0).alias("label"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("alone"))
    positives = hist.agg(F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)).alias("positives"))
    return own.union(every).crossJoin(F.broadcast(positives))  # one row


def with_costs(patterns: dict[str, str], costs: dict[str, float] | None) -> dict[str, float]:
    """The cost of each pattern, from a table of measured costs; 1 where none is known."""
    return {name: float((costs or {}).get(name, 1.0)) for name in patterns}


def per_pattern(hist: DataFrame, patterns: dict[str, str], floor: float = 0.9, costs: dict[str, float] | None = None) -> DataFrame:
    """Of each pattern hits, tp, fp, tp that no other has, precision (1 without hits), its share of all positives, and advice.

    The advice is the first that holds: no hits; low precision without or with own positives; a double with or without
    false positives; dear (over a quarter of all costs) for little; to be kept (own share 0.005 or more); open.
    """
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    y = F.col("label") == 1
    out = _per_hit(hist, patterns).groupBy("pattern", "positives").agg(F.sum("n").alias("hits"), n(y).alias("tp"), n(~y | y.isNull()).alias("fp"), n(F.col("alone") & y).alias("unique_tp"))
    cost = with_costs(patterns, costs)
    share = F.create_map(*[x for k, v in cost.items() for x in (F.lit(k), F.lit(v / max(sum(cost.values()), 1e-12)))])[F.col("pattern")]
    precision = F.when(F.col("hits") == 0, 1.0).otherwise(ratio(F.col("tp"), F.col("hits")))
    recall = ratio(F.col("unique_tp"), F.col("positives"))
    own = F.col("unique_tp") > 0
    advice = (
        F.when(F.col("hits") == 0, "drop: no hits")
        .when((precision < floor) & ~own, "drop: imprecise")
        .when((precision < floor) & own, "rewrite")
        .when(~own & (F.col("fp") > 0), "drop: double")
        .when(~own & (F.col("tp") > 0), "double")
        .when((share > 0.25) & (recall < 0.01), "dear")
        .when((precision >= floor) & (recall >= 0.005), "keep")
        .otherwise("open")
    )
    return out.select("pattern", "hits", "tp", "fp", "unique_tp", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("unique_recall"), advice.alias("advice"))


def removal_impact(hist: DataFrame, patterns: dict[str, str], mode: str = "exclusive") -> DataFrame:
    """What dropping each pattern loses: all rows it hits (drop_hits) or only those no other hits (exclusive)."""
    hit = F.lit(True) if mode == "drop_hits" else F.col("alone")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    y = F.col("label") == 1
    out = _per_hit(hist, patterns).groupBy("pattern", "positives").agg(n(hit & y).alias("tp_lost"), n(hit & ~y).alias("fp_saved"))
    return out.select("pattern", "tp_lost", "fp_saved", F.round(ratio(F.col("tp_lost"), F.col("positives")), 6).alias("recall_lost"))


def subsets(hist: DataFrame, patterns: dict[str, str], floor: float | None = None, costs: dict[str, float] | None = None) -> DataFrame:
    """Every subset of patterns with tp, fp, precision, recall, f1, cost; those under the floor of precision left out.

    Rows that a subset hits are all but those whose mask lies in its complement, so sums over sub-masks give tp and fp:
    one pass per pattern over 2^k rows, in place of every subset against every mask.
    """
    if len(patterns) > MAX_SUBSETS:
        raise ValueError(f"{len(patterns)} patterns have too many subsets; {MAX_SUBSETS} at most, or greedy")
    cost = with_costs(patterns, costs)
    spark, k = hist.sparkSession, len(patterns)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    known = hist.groupBy("mask").agg(n(F.col("label") == 1).alias("pos"), n(F.col("label") != 1).alias("neg"))
    below = spark.range(0, 1 << k).withColumnRenamed("id", "mask").join(F.broadcast(known), "mask", "left").na.fill(0)  # at most 2^16 rows
    for bit in range(k):
        # a mask with this bit takes over what the mask without it has
        moved = below.select("*", F.explode(F.when(F.col("mask").bitwiseAND(F.lit(1 << bit)) == 0, F.array("mask", F.col("mask") + (1 << bit))).otherwise(F.array("mask"))).alias("to"))
        below = moved.groupBy(F.col("to").alias("mask")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = F.broadcast(known.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")))  # one row
    full = (1 << k) - 1
    out = below.select((F.lit(full) - F.col("mask")).alias("subset"), "pos", "neg").where("subset > 0").join(totals)
    tp, fp = F.coalesce("positives", F.lit(0)) - F.col("pos"), F.coalesce("negatives", F.lit(0)) - F.col("neg")
    price = sum([F.when(F.col("subset").bitwiseAND(F.lit(b)) != 0, F.lit(cost[name])).otherwise(0.0) for name, b in bits(patterns)], F.lit(0.0))
    out = out.select("subset", tp.alias("tp"), fp.alias("fp"), F.coalesce("positives", F.lit(0)).alias("positives"), price.alias("cost"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("positives"))
    out = out.select(
        "subset", "tp", "fp", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"),
        F.round(ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives")), 6).alias("f1"), F.round("cost", 6).alias("cost"),
    )
    return out if floor is None else out.where(F.col("precision") >= floor)


def pareto(found: DataFrame) -> DataFrame:
    """Subsets that no other beats on recall and cost: of each cost the best recall, and more than all cheaper ones reach."""
    best = found.groupBy("cost").agg(F.max("recall").alias("best"))
    cheaper = Window.orderBy("cost").rowsBetween(Window.unboundedPreceding, -1)  # a row per cost, at most 2^16
    best = best.withColumn("before", F.max("best").over(cheaper)).where("before IS NULL OR best > before")
    return found.join(F.broadcast(best.select("cost", F.col("best").alias("recall"))), ["cost", "recall"], "left_semi")


def greedy(hist: DataFrame, patterns: dict[str, str], floor: float, costs: dict[str, float] | None = None) -> DataFrame:
    """Adds the pattern that gains most recall for its cost while precision holds, of equal ones the first by name.

    What the chosen hit already gains nothing, so a step is one aggregation over the rows that none of them hits.
    """
    hist = _kept(named(hist, patterns))
    cost = with_costs(patterns, costs)
    spark = hist.sparkSession
    prices = spark.createDataFrame([(n, max(c, 0.001)) for n, c in cost.items()], "pattern string, cost double")
    y = F.col("label") == 1
    gain = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    chosen, steps, tp, fp = [], [], 0, 0
    while len(chosen) < len(patterns):
        rest = hist.where(~F.arrays_overlap("hits", F.array(*[F.lit(c) for c in chosen]))) if chosen else hist
        gains = rest.select(F.explode("hits").alias("pattern"), "label", "n").groupBy("pattern").agg(gain(y).alias("tp"), gain(~y).alias("fp"))
        fits = gains.where((F.col("tp") > 0) & ((F.col("tp") + tp) / (F.col("tp") + F.col("fp") + (tp + fp)) >= floor))
        best = fits.join(F.broadcast(prices), "pattern").orderBy(F.desc(F.col("tp") / F.col("cost")), "pattern").first()  # a row per pattern
        if best is None:
            break
        chosen.append(best["pattern"])
        tp, fp = tp + best["tp"], fp + best["fp"]
        steps.append((len(steps) + 1, best["pattern"], tp, fp))
    return spark.createDataFrame(steps, "step int, pattern string, tp long, fp long")


def _kept(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "histogram")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def false_positives(df: DataFrame, patterns: dict[str, str], stats: DataFrame, worst: int = 5, each: int = 3, key: str = "doc_id") -> DataFrame:
    """pattern, key, example (120 characters, no line ends) of the least precise patterns with hits: the first rows by key.

    One scan: a row goes to every chosen pattern that it hits, and each task keeps a pattern's smallest keys.
    """
    chosen = [r["pattern"] for r in stats.where("hits > 0 AND fp > 0").orderBy("precision", "pattern").limit(worst).collect()]
    found = F.array(*[F.when(rules.hits(F.col("text"), patterns[p]), F.lit(p)) for p in chosen]) if chosen else F.array().cast("array<string>")
    rows = df.where("label <> 1").select(key, F.translate(F.substring("text", 1, 120), "\n", " ").alias("example"), F.explode(F.filter(found, lambda p: p.isNotNull())).alias("pattern"))
    rank = F.row_number().over(Window.partitionBy("pattern").orderBy(key))  # limited per task before the shuffle
    return rows.withColumn("rank", rank).where(F.col("rank") <= each).select("pattern", key, "example")
