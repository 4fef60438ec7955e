"""Two-stage verdicts, their merge, fallback chains and model health."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features, rules, text
from ..sources.scratch import scratch
from .models import Model, scores

# The fallback chain and the models' limits in seconds.
CHAIN = ["tfidf", "bert", "rnn", "regex"]
LIMITS = {"regex": 0.05, "tfidf": 0.1, "rnn": 0.5, "bert": 1.0}
OTHER_LIMIT = 0.2


def classify(
    df: DataFrame, mode: str = "both", toxic: dict[str, str] = rules.TOXIC, junk: dict[str, str] = rules.SPAM, tox_model: Model | None = None, spam_model: Model | None = None, key: str = "doc_id"
) -> DataFrame:
    """df (key, text and more) with both verdicts; a side that the mode switches off is a stub and is never planned.

    Rules first: they are searched once per row. What they miss goes to the side's model, if there is one (else the
    verdict is the rules' own, score 0, and says so). On the spam side capitals rules decide with score 1 before the
    model. Empty text is a stub, blank text scores 0. Different texts of a key are scored once.
    With a model, what the rules found is written to shared storage here, so calling this runs a job on df.
    """
    if mode not in ("both", "tox_only", "spam_only"):
        raise ValueError(f"mode {mode}")
    t, names = F.col("text"), df.columns
    empty = text.clean(t) == ""
    found = {"_empty": empty, "_blank": text.strip(text.clean(t)) == ""}
    if mode != "spam_only":
        found |= {"_tox_hit": rules.any_hit(t, toxic)}
    if mode != "tox_only":
        found |= {"_spam_hit": rules.any_hit(t, junk), "_caps": features.matches_caps_shout(t) | features.matches_caps_word(t)}
    rows = df.withColumns(found)
    if mode != "spam_only":
        rows = rows.withColumn("_types", F.when(F.col("_tox_hit"), rules.names(rules.categories(t, toxic))).otherwise(""))
    rows = rows.withColumn("_tox_score", F.lit(0.0)).withColumn("_spam_score", F.lit(0.0))
    sides = [("tox", tox_model if mode != "spam_only" else None, ["_tox_hit", "_blank"]), ("spam", spam_model if mode != "tox_only" else None, ["_spam_hit", "_caps", "_blank"])]
    if any(model for _, model, _ in sides):
        # what the rules found is kept, so no search runs again for the branches below
        path = scratch(df.sparkSession, "rule-hits")
        rows.write.parquet(path)
        rows = df.sparkSession.read.schema(rows.schema).parquet(path).withColumn("_h", F.xxhash64("text"))
        base = rows
        for side, model, known in sides:
            if model:
                missed = base.where(~reduce(or_, [F.col(c) for c in known])).select(key, "text")
                made = scores(model, missed, key).select(F.col(key), F.col("h").alias("_h"), F.col("score").alias("_made"))
                rows = rows.drop(f"_{side}_score").join(made, [key, "_h"], "left").withColumn(f"_{side}_score", F.coalesce("_made", F.lit(0.0))).drop("_made")
    own = [F.col(f"`{c}`") for c in names]
    return rows.select(*own, *(_tox_stub() if mode == "spam_only" else _toxicity(tox_model)), *(_spam_stub() if mode == "tox_only" else _spam(spam_model)))


def merge(messages: DataFrame, tox: DataFrame, spam: DataFrame, key: str) -> DataFrame:
    """messages (key) with the verdicts of both sides, judged apart; a message that a side lacks gets its stub."""
    sides = [(tox, _tox_stub(), ["is_toxic", "toxicity_score", "toxicity_types", "tox_model_used"]), (spam, _spam_stub(), ["is_spam", "spam_score", "spam_model_used"])]
    for verdicts, stub, names in sides:
        messages = messages.join(verdicts.select(key, *names), key, "left").withColumns({n: F.coalesce(n, s) for n, s in zip(names, stub)})
    return messages


def _tox_stub() -> list[Column]:
    return [F.lit(False).alias("is_toxic"), F.lit(0.0).alias("toxicity_score"), F.lit("").alias("toxicity_types"), F.lit(None).cast("string").alias("tox_model_used")]


def _spam_stub() -> list[Column]:
    return [F.lit(False).alias("is_spam"), F.lit(0.0).alias("spam_score"), F.lit(None).cast("string").alias("spam_model_used")]


def _toxicity(model: Model | None) -> list[Column]:
    empty, hit = F.col("_empty"), F.col("_tox_hit")
    score = F.when(hit, 1.0).when(F.col("_blank"), 0.0).otherwise(F.col("_tox_score"))
    return [
        F.when(empty, False).otherwise(score >= (model.threshold if model else 0.5)).alias("is_toxic"),
        F.when(empty, 0.0).otherwise(score).alias("toxicity_score"),
        F.col("_types").alias("toxicity_types"),
        F.when(empty, None).when(hit, "regex").otherwise("tfidf" if model else "regex").alias("tox_model_used"),
    ]


def _spam(model: Model | None) -> list[Column]:
    """Without a model the capitals rules, which belong to stage two, do not decide."""
    empty, hit = F.col("_empty"), F.col("_spam_hit")
    score = F.when(hit, 1.0).when(F.col("_caps") & F.lit(model is not None), 1.0).when(F.col("_blank"), 0.0).otherwise(F.col("_spam_score"))
    return [
        F.when(empty, False).otherwise(score >= (model.threshold if model else 0.5)).alias("is_spam"),
        F.when(empty, 0.0).otherwise(score).alias("spam_score"),
        F.when(empty, None).when(hit, "regex").otherwise("tfidf" if model else "regex").alias("spam_model_used"),
    ]


def fallback(attempts: DataFrame, preferred: str | None = None, chain: list[str] = CHAIN) -> DataFrame:
    """For (msg, model, score, error, elapsed): the first usable model of the chain, the preferred one before it."""
    order = ([preferred] if preferred else []) + [m for m in chain if m != preferred]
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    limit = F.coalesce(F.create_map(*[x for k, v in LIMITS.items() for x in (F.lit(k), F.lit(v))])[F.col("model")], F.lit(OTHER_LIMIT))
    usable = attempts.where(F.col("error").isNull() & (F.col("elapsed") <= limit)).withColumn("rank", rank).where("rank > 0")
    return usable.groupBy("msg").agg(F.min_by(F.struct("model", "score"), "rank").alias("used")).select("msg", "used.model", "used.score")


def health(attempts: DataFrame) -> DataFrame:
    """model, errors, successes, skipped: over 10 errors, some success, more than half errors."""
    counts = attempts.groupBy("model").agg(F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("error").isNull()).alias("successes"))
    share = F.col("errors") / (F.col("errors") + F.col("successes"))
    return counts.withColumn("skipped", (F.col("errors") > 10) & (F.col("successes") > 0) & (share > 0.5))
