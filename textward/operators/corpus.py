"""Corpus work: labels, distinct texts, splits, folds, quotas, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features, rules, text
from ..sources.scratch import scratch

# Label aliases.
POSITIVE = ["spam", "junk", "toxic", "1", "true", "yes", "y"]
NEGATIVE = ["ham", "not_spam", "0", "false", "no", "n"]


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that lists the columns found."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def label_01(value: Column) -> Column:
    """Corpus labels: null 0, nonzero numbers 1, aliases, any other nonempty string 1."""
    s = F.lower(F.trim(value.cast("string")))
    number = s.try_cast("double")
    return (
        F.when(value.isNull() | (s == ""), 0).when(number.isNotNull(), (number != 0).cast("int")).when(s.isin(POSITIVE), 1).when(s.isin(NEGATIVE), 0).otherwise(1)
    )


def label_bool(value: Column) -> Column:
    """Evaluation labels: numbers truncated first, aliases, unknown null."""
    s = F.lower(F.trim(value.cast("string")))
    number = s.try_cast("double")
    return F.when(number.isNotNull(), number.cast("long") != 0).when(s.isin(POSITIVE), True).when(s.isin(NEGATIVE), False)


def hash_order(seed: str, key: Column) -> Column:
    """A repeatable draw per key in [0, 2^32), independent of partitions."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long")


def sample(df: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """n rows of df (all, where it has fewer), drawn by hash of the key; each task keeps its first n before they meet."""
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def distinct_on(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row (smallest `order`) of each key; a partial aggregate, so common keys are merged before the shuffle."""
    rest = [c for c in df.columns]
    first = df.groupBy(key.alias("distinct_key")).agg(F.min_by(F.struct(*rest), F.col(order)).alias("first"))
    return first.select(*[F.col(f"first.{c}").alias(c) for c in rest])


def rank_within(df: DataFrame, group: str, cut: Column, order: list[str]) -> DataFrame:
    """df with rank (from 0, by order) and all (rows) within each group.

    cut is a number that never falls along the order. Ranks come from counts per (group, cut) plus a rank inside the
    cut, so no group is sorted as one.
    """
    df = df.withColumn("cut", cut)
    totals = df.groupBy(group, "cut").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("own").orderBy("cut")
    totals = totals.withColumn("own", F.struct(group)).withColumn("before", F.sum("n").over(run) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("own")))
    inside = F.row_number().over(Window.partitionBy("own", "cut").orderBy(*order))
    ranked = df.withColumn("own", F.struct(group)).withColumn("inside", inside).join(totals.select("own", "cut", "before", "all"), ["own", "cut"])
    return ranked.withColumn("rank", F.col("before") + F.col("inside") - 1).drop("own", "cut", "before", "inside")


def row_range(df: DataFrame, key: str, start: int, stop: int | None = None) -> DataFrame:
    """The rows at positions start to stop (not included; None: to the end) in order of key, for sharded runs.

    Positions come from a range of keys per task and the counts of the ranges before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(df.sparkSession, "ranges")
    df.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = df.sparkSession.read.parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    offsets = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    placed = dealt.join(F.broadcast(offsets), "_part").withColumn("_place", place).where(F.col("_place") >= start)
    return (placed if stop is None else placed.where(F.col("_place") < stop)).select(*df.columns)


def lemmatise(rows: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, out: words of the lower-cased text through a (word, lemma) table, each in its place; a word without a line stays.

    Each different word of a text is looked up once, and only lines that change a word take part, so the commonest words
    meet nothing; what is found returns to its text as a map.
    """
    own = rows.select(key, F.xxhash64("text").alias("h"), text.tokens(F.lower(text.clean(F.col("text")))).alias("words"))
    asked = own.select(key, "h", F.explode(F.array_distinct("words")).alias("word")).distinct()
    found = asked.join(dictionary.where("word <> lemma"), "word").groupBy(key, "h").agg(F.map_from_entries(F.collect_list(F.struct("word", "lemma"))).alias("lemmas"))
    placed = F.transform("words", lambda w: F.coalesce(F.try_element_at("lemmas", w), w))
    return own.join(found, [key, "h"], "left").select(key, F.translate(F.array_join(F.when(F.col("lemmas").isNull(), F.col("words")).otherwise(placed), " "), "ёъ", "еь").alias("out"))


def split(df: DataFrame, label: str, key: str, shares: dict[str, float], seed: str = "split-1") -> DataFrame:
    """df with a column part: exact shares within each label, by hash order.

    Ranks come from counts per (label, hash range) plus a rank inside the range, so no label is sorted as one group.
    """
    df = df.withColumn("draw", hash_order(seed, F.col(key)))
    ranked = rank_within(df, label, F.shiftright("draw", 22), ["draw", key])
    part, upto = None, 0.0
    for name, share in shares.items():
        upto += share
        test = F.col("rank") < F.floor(F.col("all") * round(upto, 9) + 0.5)
        part = F.when(test, name) if part is None else part.when(test, name)
    return ranked.withColumn("part", part).select(*df.drop("draw").columns, "part", "rank")


def repair_labels(df: DataFrame) -> DataFrame:
    """Rows that a capitals rule matches get label 1, others whether their label is not 0."""
    rule = features.matches_caps_word(F.col("text")) | features.matches_caps_shout(F.col("text"))
    return df.withColumn("label", F.when(rule, 1).otherwise((F.col("label") != 0).cast("int")))


def invert_labels(df: DataFrame, patterns: dict[str, str] = rules.TOXIC) -> DataFrame:
    """1 where the label is not set or a pattern hits."""
    return df.withColumn("label", F.when((F.coalesce("label", F.lit(0)) == 0) | rules.any_hit(F.col("text"), patterns), 1).otherwise(0))


def adapt(df: DataFrame, text_col: str, label_col: str, key: str) -> DataFrame:
    """Strip and lower, drop empty, first of equal texts, labels to 0/1."""
    require(df, [text_col, label_col, key])
    own = df.select(key, F.lower(text.strip(text.clean(F.col(text_col)))).alias("text"), label_01(F.col(label_col)).alias("label")).where("text <> ''")
    return distinct_on(own, F.col("text"), key)


def quota(df: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """At most n/10 positives (1 at least), the rest negatives, in order of key."""
    positives = max(1, n // 10)
    first = lambda y, m: df.where(F.col(label) == y).orderBy(key).limit(m)  # noqa: E731  (each task keeps its first m)
    return first(1, positives).unionByName(first(0, n - positives))
