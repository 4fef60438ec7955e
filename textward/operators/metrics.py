"""Evaluation: confusion counts, curves, thresholds, correlations, weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from . import grams
from .prefix import prefix_sum, prefix_sum_by


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rounded(x: Column, digits: int = 6) -> Column:
    """x as DuckDB rounds it: scaled first, then half away from zero. F.round rounds the printed number, which differs at some ties."""
    return F.round(x * 10.0**digits) / 10.0**digits


def confusion(predicted: Column, label: Column) -> list[Column]:
    """Aggregates tp, fp, fn, tn of a boolean prediction against a 0/1 label."""
    y = label == 1
    return [F.count_if(predicted & y).alias("tp"), F.count_if(predicted & ~y).alias("fp"), F.count_if(~predicted & y).alias("fn"), F.count_if(~predicted & ~y).alias("tn")]


def with_prf(df: DataFrame, digits: int = 6) -> DataFrame:
    """Adds precision, recall, f1 from tp, fp, fn; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns(
        {
            "precision": F.round(ratio(tp, tp + fp), digits),
            "recall": F.round(ratio(tp, tp + fn), digits),
            "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), digits),
        }
    )


def curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """A row per distinct score t: tp, fp of `score >= t`, with precision and recall. Scores are counted before sorting."""
    counts = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    run = prefix_sum(counts.where("threshold is not null"), "threshold", ["pos", "neg"])
    total = F.broadcast(df.agg(F.count_if((F.col(label) == 1) & F.col(score).isNotNull()).alias("all_pos")))  # one row
    run = run.join(total)
    return run.select(
        "threshold", "pos", "neg", F.col("run_pos").alias("tp"), F.col("run_neg").alias("fp"), "all_pos",
        ratio(F.col("run_pos"), F.col("run_pos") + F.col("run_neg")).alias("precision"), ratio(F.col("run_pos"), F.col("all_pos")).alias("recall"),
    )


def best_threshold(points: DataFrame, floor: float = 0.9, by: str = "recall") -> DataFrame:
    """The threshold with most recall (or f1) among precision >= floor; none valid: among all; ties: lowest; none: 0.5."""
    p, r = F.col("precision"), F.col("recall")
    goal = r if by == "recall" else F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    best = F.max(F.struct((p >= floor).alias("ok"), goal.alias("goal"), (-F.col("threshold")).alias("low"))).alias("best")
    return points.agg(best).select(F.coalesce(-F.col("best.low"), F.lit(0.5)).alias("threshold"))


def average_precision(points: DataFrame) -> DataFrame:
    """Sum over scores, descending, of recall gained times precision."""
    return points.agg(F.sum(ratio(F.col("pos"), F.col("all_pos")) * F.col("precision")).alias("ap"))


def roc_auc(points: DataFrame) -> DataFrame:
    """Area by rank sum, ties counted half: each negative meets the positives above it."""
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return points.agg(won.alias("won"), F.max("all_pos").alias("p"), F.sum("neg").alias("n")).select(ratio(F.col("won"), F.col("p") * F.col("n")).alias("auc"))


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a Pearson r over n rows: the t distribution's tail by its incomplete beta continued fraction.

    For the few aggregated rows of a feature table; None where r is undefined or n < 3.
    """
    if r is None or r != r or n < 3:
        return None
    a, b, x = (n - 2) / 2.0, 0.5, 1.0 - min(1.0, r * r)
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * _beta_fraction(a, b, x) / a)
    return max(0.0, 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The fraction 1/(1+ d1/(1+ d2/(1+ ...))), evaluated from its tail; 400 terms are ample on the side it is used."""
    tail = 1.0
    for k in range(400, 0, -1):
        m = k // 2
        d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        tail = 1.0 + d / tail
    return 1.0 / tail


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """label, n, weight: n_all / (classes x n)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")))  # one row
    return counts.join(total).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def focal_loss(logit: Column, label: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Binary focal loss of a logit, by a stable log-sigmoid."""
    log_p = lambda x: F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))
    y = label.cast("double")
    log_pt = y * log_p(logit) + (1 - y) * log_p(-logit)
    return -(alpha * y + (1 - alpha) * (1 - y)) * F.pow(1 - F.exp(log_pt), F.lit(gamma)) * log_pt


SHARES = (0.5, 0.95, 0.99, 0.999)


def share_name(share: float) -> str:
    return f"p{f'{share * 100:g}'.replace('.', '_')}"


def percentiles(value: Column, shares: tuple[float, ...] = SHARES, k: int | None = None) -> list[Column]:
    """Linearly interpolated percentiles with count, mean, min, max, as aggregates for groups of which each fits a task.

    With k they are values from one mergeable KLL sketch of that size (rank error some 1.5 % at k = 200, 0.2 % at 2000),
    for groups of any size.
    """
    if k is None:
        found = F.percentile(value, list(shares))
        made = [F.round(found[i], 6).alias(share_name(p)) for i, p in enumerate(shares)]
    else:
        sketch = F.kll_sketch_agg_double(value.cast("double"), F.lit(k))
        made = [F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))).alias(share_name(p)) for p in shares]
    return [F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), *made]


def selected(df: DataFrame, by: list[str], value: Column, shares: tuple[float, ...] = SHARES, bins: int = 1024, small: int = 100_000) -> DataFrame:
    """by, share, value: exact linearly interpolated percentiles of groups of any size.

    An order statistic lies in a range of values. While that holds more than `small` rows, they are counted in bins and
    the bin that holds the statistic is the next range; then the range's rows are ranked. So no group is held or sorted
    by one task, and rows outside the ranges are only counted. Nulls are left out.
    """
    rows = df.select(F.struct(*([F.col(c) for c in by] or [F.lit(0).alias("all")])).alias("own"), value.cast("double").alias("v")).where("v IS NOT NULL")
    place = F.col("share") * (F.col("n") - 1)
    wanted = rows.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).withColumn("share", F.explode(F.array(*[F.lit(float(p)) for p in shares])))
    wanted = _kept(wanted.select("*", place.alias("place"), F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank"), F.lit(0).cast("long").alias("before")))
    span = ["own", "low", "high"]
    while wanted.where((F.col("n") > small) & (F.col("low") < F.col("high"))).limit(1).count():
        wide = wanted.where((F.col("n") > small) & (F.col("low") < F.col("high")))
        inside = _between(rows, wide.select(*span).distinct())
        spot = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins))
        counts = inside.groupBy(*span, spot.alias("bin")).agg(F.count(F.lit(1)).alias("bin_n"), F.min("v").alias("bin_low"), F.max("v").alias("bin_high"))
        counts = counts.withColumn("under", F.sum("bin_n").over(Window.partitionBy(*span).orderBy("bin")) - F.col("bin_n"))  # over `bins` rows
        found = wide.join(counts, span).where((F.col("rank") >= F.col("before") + F.col("under")) & (F.col("rank") < F.col("before") + F.col("under") + F.col("bin_n")))
        found = found.select("own", F.col("bin_n").alias("n"), F.col("bin_low").alias("low"), F.col("bin_high").alias("high"), "share", "place", "rank", (F.col("before") + F.col("under")).alias("before"))
        wanted = _kept(found.unionByName(wanted.where((F.col("n") <= small) | (F.col("low") >= F.col("high")))))
    plain = wanted.where("low >= high").select("own", "share", "place", "rank", F.col("low").alias("v"))
    open_ = wanted.where("low < high")
    inside = _between(rows, open_.select(*span).distinct())
    inside = inside.withColumn("at", F.row_number().over(Window.partitionBy(*span).orderBy("v")) - 1)
    ranked = open_.join(inside, span).where(F.col("rank") == F.col("before") + F.col("at")).select("own", "share", "place", "rank", "v")
    ends = plain.union(ranked).groupBy("own", "share", "place").agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"))
    part = F.col("place") - F.floor("place")
    return ends.select(*[F.col(f"own.{c}").alias(c) for c in by], "share", (F.col("a") + (F.col("b") - F.col("a")) * part).alias("value"))


def _between(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows (own, v) in each of the spans (own, low, high; two for each share asked of a group)."""
    return rows.join(spans, "own").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))


def _kept(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "wanted")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def percentile_table(df: DataFrame, by: list[str], value: Column, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """by, n, mean, least, most and a column per share: as percentiles(), exactly and for groups of any size."""
    stats = df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    found = selected(df, by, value, shares).withColumn("name", F.format_string("s%.6f", "share"))
    wide = found.groupBy(*by).pivot("name", [f"s{p:.6f}" for p in shares]).agg(F.round(F.first("value"), 6))
    wide = wide.select(*by, *[F.col(f"`s{p:.6f}`").alias(share_name(p)) for p in shares])
    return stats.join(wide, by, "left")


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with columns less their mean, over their population deviation (1 where that is 0): one aggregation."""
    stats = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.avg, F.stddev_pop)])  # one row
    rows = df.join(F.broadcast(stats))
    own = {c: (F.col(c) - F.col(f"avg_{c}")) / F.when(F.col(f"stddev_pop_{c}") == 0, 1.0).otherwise(F.col(f"stddev_pop_{c}")) for c in columns}
    return rows.select(*[own[c].alias(c) if c in own else F.col(c) for c in df.columns])


def pearson(a: str, b: str) -> Column:
    """Pearson's r as an aggregate, null where a column is constant (corr fails there)."""
    a, b = F.col(a).cast("double"), F.col(b).cast("double")
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r: Pearson's r of every pair, null where a column is constant; one aggregation."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    found = df.agg(*[pearson(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return found.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])))


def feature_table(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """feature, n, r with the label, mean of either class, their difference, and the AUC of the feature alone, 0.5 at least."""
    stacked = df.select(F.col(label).alias("label"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in columns])))
    mean = lambda y: F.avg(F.when(F.col("label") == y, F.col("v")))
    stats = stacked.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), pearson("v", "label").alias("r"), mean(1).alias("mean_1"), mean(0).alias("mean_0")
    )
    counts = stacked.where("v is not null").groupBy("feature", F.col("v").cast("double").alias("v")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    won = F.sum(F.col("neg") * (F.col("run_pos") - F.col("pos") / 2.0))
    auc = prefix_sum_by(counts, "feature", "v", ["pos", "neg"]).groupBy("feature").agg(ratio(won, F.sum("pos") * F.sum("neg")).alias("auc"))
    aucs = auc.select("feature", F.greatest("auc", 1 - F.col("auc")).alias("auc"))
    return stats.withColumn("delta", F.col("mean_1") - F.col("mean_0")).join(F.broadcast(aucs), "feature", "left")  # a row per feature


def term_lift(terms: DataFrame, rows: DataFrame) -> DataFrame:
    """term, d1, d0, rate_1, rate_0, lift from (label, term), each term once per document, and the documents (label)."""
    sizes = F.broadcast(rows.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")))  # one row
    counts = terms.groupBy("term").agg(F.count_if(F.col("label") == 1).alias("d1"), F.count_if(F.col("label") == 0).alias("d0"))
    lift = F.when(F.col("d0") == 0, 1e308).otherwise(rounded(F.try_divide(F.col("d1") / F.col("n1"), F.col("d0") / F.col("n0"))))
    return counts.join(sizes).select("term", "d1", "d0", rounded(F.try_divide("d1", "n1")).alias("rate_1"), rounded(F.try_divide("d0", "n0")).alias("rate_0"), lift.alias("lift"))


def ngram_sweep(df: DataFrame, settings: list[tuple[int, int, int]]) -> DataFrame:
    """least, most, max_features, vocabulary, nonzeros_per_doc of (doc_id, made) for each setting.

    The rows of a doc_id are one text. N-grams are counted once, at the largest range; a narrower range has those that are
    neither shorter nor longer. Padded words have three characters at least, so only beyond that a least size has terms of
    its own and is counted by itself.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = df.count()
    own = df.repartition(n, "doc_id").groupBy("doc_id").agg(F.array(F.array_join(F.collect_list("made"), " ")).alias("made"))
    alike: dict[int, list[tuple[int, int, int]]] = {}
    for setting in settings:
        alike.setdefault(max(3, setting[0]), []).append(setting)
    found = []
    for same in alike.values():
        counts = _kept(grams.totals(own, ["all"], (min(s[0] for s in same), max(s[1] for s in same))).select("term", "total", "df"))
        for least, upto, limit in sorted(same, key=lambda s: s[0]):
            best = counts.where(F.char_length("term").between(min(least, 3), upto)).orderBy(F.desc("total"), "term").limit(limit)
            made = best.agg(F.count(F.lit(1)).alias("vocabulary"), F.round(F.sum("df") / F.lit(float(max(total, 1))), 4).alias("nonzeros_per_doc"))
            found.append(made.select(F.lit(least).alias("least"), F.lit(upto).alias("most"), F.lit(limit).alias("max_features"), "vocabulary", "nonzeros_per_doc"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def evaluate(df: DataFrame, sides: dict[str, tuple[str, str]]) -> DataFrame:
    """side, confusion counts, precision, recall, f1 of each side's (predicted, label) columns; rows without a label are skipped."""
    stacked = F.inline(F.array(*[F.struct(F.lit(k).alias("side"), F.col(p).alias("p"), F.col(y).cast("int").alias("label")) for k, (p, y) in sides.items()]))
    return with_prf(df.select(stacked).where("label IS NOT NULL").groupBy("side").agg(*confusion(F.col("p"), F.col("label"))))


def fold_summary(folds: DataFrame) -> DataFrame:
    """mean, std (population), least, most of the score of (fold, score, threshold), the best fold and its threshold."""
    return folds.agg(
        F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std"), F.min("score").alias("least"), F.max("score").alias("most"),
        F.max_by("fold", "score").alias("best"), F.max_by("threshold", "score").alias("threshold"),
    )
