"""Tables of tasks, verdicts and cached results: lookups, splits, upserts, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def cache_lookup(items: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """items (with key) left-joined to unexpired cache rows (key, verdict, cached_at, ttl_s); blank texts never hit.

    The latest row of a key counts, taken by a partial aggregate, so neither side multiplies rows.
    """
    fresh = cache.where(F.col("cached_at") + F.make_dt_interval(secs=F.col("ttl_s").cast("decimal(18,6)")) > now)
    fresh = fresh.groupBy("key").agg(F.max_by("verdict", "cached_at").alias("verdict"))
    full = F.trim(F.coalesce("text", F.lit(""))) != ""  # blank texts get keys of their own that no cache has, over many tasks
    spread = F.pmod(F.xxhash64(*items.columns), F.lit(4096)).cast("string")  # by the row itself, so a task that runs again deals alike
    asked = items.withColumn("asked", F.when(full, F.col("key")).otherwise(F.concat(F.lit("blank-"), spread)))
    return asked.join(fresh.withColumnRenamed("key", "asked"), "asked", "left").drop("asked")


def split_batches(looked_up: DataFrame, batch: str = "task_id") -> DataFrame:
    """Which part of its batch each item goes to: all_hit, all_miss, or partial with hit and miss apart."""
    hit = F.col("verdict").isNotNull()
    shape = looked_up.groupBy(batch).agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    case = F.when(F.col("hits") == F.col("n"), "all_hit").when(F.col("hits") == 0, "all_miss").otherwise("partial")
    return looked_up.join(shape.select(batch, case.alias("case")), batch).withColumn("part", F.when(hit, "completed").otherwise("queued"))


def realign(looked_up: DataFrame, results: DataFrame, batch: str = "task_id", order: str = "item_index") -> DataFrame:
    """Results of the misses back to their items by rank; batches whose counts differ are left out."""
    rank = F.row_number().over(Window.partitionBy(batch).orderBy(order))
    missed = looked_up.where("verdict is null").withColumn("rank", rank)
    got = results.withColumn("rank", rank)
    same = missed.groupBy(batch).agg(F.count(F.lit(1)).alias("n")).join(got.groupBy(batch).agg(F.count(F.lit(1)).alias("n")), [batch, "n"]).select(batch)
    return missed.join(same, batch, "left_semi").join(got.select(batch, "rank", F.col("verdict").alias("answer")), [batch, "rank"]).select(batch, order, "answer")


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], version: str = "updated_at") -> DataFrame:
    """Per key the row with the latest version, updates before current of equal versions; replays change nothing."""
    rest = [c for c in current.columns if c not in keys]
    both = current.withColumn("newer", F.lit(0)).unionByName(updates.select(*current.columns).withColumn("newer", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(version), F.col("newer"))).alias("row")).select(*keys, "row.*")


def cascade_delete(tables: list[DataFrame], gone: DataFrame, key: str) -> list[DataFrame]:
    """The tables without the rows of the deleted keys."""
    return [t.join(gone.select(key).distinct(), key, "left_anti") for t in tables]


def transition(tasks: DataFrame, updates: DataFrame, key: str = "task_id") -> DataFrame:
    """tasks with the latest status of updates (key, status, at, error); completed and failed set completed_at."""
    last = updates.groupBy(key).agg(F.max_by(F.struct("status", "at", "error"), "at").alias("u"))
    ended = F.col("u.status").isin("completed", "failed")
    return tasks.join(last, key, "left").select(
        key,
        F.coalesce("u.status", "status").alias("status"),
        "created_at",
        F.when(ended, F.col("u.at")).otherwise(F.col("completed_at")).alias("completed_at"),
        F.when(F.col("u.status") == "failed", F.col("u.error")).alias("error"),
    )


def fail_items(items: DataFrame, tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """items with the error of their task where it failed."""
    failed = tasks.where("status = 'failed'").select(key, F.col("error").alias("_error"))
    return items.join(failed, key, "left").withColumn("error", F.coalesce("_error", "error")).drop("_error")


def read_model(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """task_id, status, results, error, user_id of each task.

    Results are the verdicts in order of index, missing fields at their defaults, and are there only when the task
    completed or failed; error is the first item's, when it failed; user_id is the first item's.
    """
    verdict = F.struct(
        "item_index", F.coalesce("is_toxic", F.lit(False)).alias("is_toxic"), F.coalesce("toxicity_score", F.lit(0.0)).alias("toxicity_score"), "tox_model_used",
        F.coalesce("is_spam", F.lit(False)).alias("is_spam"), F.coalesce("spam_score", F.lit(0.0)).alias("spam_score"), "spam_model_used", "error",
    )
    listed = items.groupBy("task_id").agg(F.array_sort(F.collect_list(verdict)).alias("results"), F.min_by(F.struct("user_id", "error"), "item_index").alias("first"))
    done = F.col("status").isin("completed", "failed")
    out = tasks.select("task_id", "status").join(listed, "task_id", "left")
    return out.select("task_id", "status", F.when(done, F.coalesce("results", F.array())).alias("results"), F.when(F.col("status") == "failed", F.col("first.error")).alias("error"), F.col("first.user_id").alias("user_id"))


def faults(side: str) -> Column:
    """How many rules a stored verdict breaks on one side (tox or spam): no flag, score not in 0 to 1, a verdict without a model."""
    flag, score, model = {"tox": ("is_toxic", "toxicity_score", "tox_model_used"), "spam": ("is_spam", "spam_score", "spam_model_used")}[side]
    one = lambda c: F.when(c, 1).otherwise(0)
    verdict = F.coalesce(F.col(flag), F.lit(False)) | (F.coalesce(score, F.lit(0.0)) != 0)
    return one(F.col(flag).isNull()) + one(F.col(score).isNull() | (F.col(score) < 0) | (F.col(score) > 1)) + one(F.col(model).isNull() & verdict)


def validity(tasks: DataFrame, items: DataFrame, key: str = "task_id") -> DataFrame:
    """key, status, n, bad_tox, bad_spam, err of every task with items."""
    found = items.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(faults("tox")).alias("bad_tox"), F.sum(faults("spam")).alias("bad_spam"), F.count("error").alias("err"))
    return tasks.select(key, "status").join(found, key)


def cache_stats() -> list[Column]:
    """Aggregates n, hits, rate over rows with from_cache."""
    hits = F.count_if(F.coalesce("from_cache", F.lit(False)))
    return [F.count(F.lit(1)).alias("n"), hits.alias("hits"), F.round(F.coalesce(F.try_divide(hits, F.count(F.lit(1))), F.lit(0.0)), 6).alias("rate")]


def dominant_models(items: DataFrame) -> DataFrame:
    """side, model, n: the model that gave most verdicts of each side; of equal ones the first by name."""
    stacked = items.select(F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("model")) for s, c in (("tox", "tox_model_used"), ("spam", "spam_model_used"))]))).where("model IS NOT NULL")
    counts = stacked.groupBy("side", "model").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("side").agg(F.min_by(F.struct("model", "n"), F.struct(-F.col("n"), F.col("model"))).alias("best")).select("side", "best.model", "best.n")


def actions(results: DataFrame) -> DataFrame:
    """chat_id, message_id, action: deletions of flagged messages of the platform whose ref names chat and message; stateless."""
    ours = (F.col("source") == "telegram") & F.col("ref.chat_id").isNotNull() & F.col("ref.message_id").isNotNull()
    return results.where(ours & (F.col("is_toxic") | F.col("is_spam"))).select("ref.chat_id", "ref.message_id", F.lit("delete").alias("action"))


def accepted(updates: DataFrame) -> DataFrame:
    """update_id, text, ref (chat, message, user) of updates whose new or edited message has a text that is not blank."""
    m = F.coalesce("message", "edited_message")
    rows = updates.select("*", m.alias("m")).where(text.strip(text.clean(F.col("m.text"))) != "")
    ref = F.struct(F.col("m.chat.id").alias("chat_id"), F.col("m.message_id").alias("message_id"), F.col("m.from.id").alias("user_id"))
    return rows.select(*[c for c in updates.columns if c not in ("message", "edited_message")], F.col("m.text").alias("text"), ref.alias("ref"))


def intended_latency(batches: DataFrame, tasks: DataFrame, start: Column, shift: float = 0.0) -> DataFrame:
    """batch, latency (seconds) of every item: completion less its planned arrival on the database's clock; negative ones left out.

    batches has batch, task_ids, arrivals (seconds after start); only batches of one task count, tasks has task_id and
    completed (seconds).
    """
    one = batches.where(F.size("task_ids") == 1).select("batch", F.col("task_ids")[0].alias("task_id"), start.alias("_start"), F.explode("arrivals").alias("_arrival"))
    late = F.col("completed") - (F.col("_start") + F.col("_arrival") + shift)
    return one.join(tasks.where("completed IS NOT NULL").select("task_id", "completed"), "task_id").select("batch", late.alias("latency")).where("latency >= 0")


def cold_hot(latencies: DataFrame, batches: DataFrame, key: str = "task_id") -> DataFrame:
    """cold, hot, ratio: mean latency of tasks from batches without and with repeated texts. batches has key and has_dup."""
    rows = latencies.join(batches.select(key, "has_dup"), key, "left").withColumn("has_dup", F.coalesce("has_dup", F.lit(False)))
    cold, hot = F.avg(F.when(~F.col("has_dup"), F.col("latency"))), F.avg(F.when(F.col("has_dup"), F.col("latency")))
    return rows.agg(F.round(cold, 6).alias("cold"), F.round(hot, 6).alias("hot"), F.round(F.try_divide(cold, hot), 6).alias("ratio"))
