"""Continuous moderation with Structured Streaming: intake, cached verdicts, cascade, verdict table, results, actions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import rules
from ..functions import text as tx
from ..operators import cascade, relational
from ..operators.models import Model
from ..sources.scratch import scratch

REQUEST = "task_id string, source string, items array<struct<text string, ref struct<chat_id bigint, message_id bigint>>>, sent_at timestamp"
_MESSAGE = "struct<text string, message_id bigint, chat struct<id bigint>, from struct<id bigint>>"
UPDATE = f"update_id long, message {_MESSAGE}, edited_message {_MESSAGE}, at timestamp"
VERDICT = ["is_toxic", "toxicity_score", "toxicity_types", "tox_model_used", "is_spam", "spam_score", "spam_model_used"]
# How long a verdict is kept, in seconds, when rules alone gave it, and otherwise.
TTL_RULES, TTL = 300, 3600
#: States over which the lookups of one key are dealt.
SALTS = 4


def requests(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Request messages from JSON files."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", per_trigger).json(path)


def parsed_requests(records: DataFrame) -> DataFrame:
    """Request messages of a queue's records (value: bytes or text, as Kafka's); records that are no request are left out."""
    message = F.from_json(F.col("value").cast("string"), REQUEST)
    return records.select(message.alias("m")).where("m.task_id IS NOT NULL AND m.items IS NOT NULL").select("m.*")


def unpack(messages: DataFrame) -> DataFrame:
    """One row per item with its position."""
    item = messages.select("task_id", "source", "sent_at", F.posexplode("items").alias("item_index", "item"))
    return item.select("task_id", "source", "sent_at", "item_index", "item.text", "item.ref", tx.cache_key(F.col("item.text")).alias("key"))


def judged(
    items: DataFrame, mode: str = "both", tox_model: Model | None = None, spam_model: Model | None = None, toxic: dict[str, str] = rules.TOXIC, junk: dict[str, str] = rules.SPAM
) -> DataFrame:
    """items (verdict: what the cache holds, or null) with their verdicts and from_cache.

    Each different text without a cached verdict is judged once: the cache is blind to case and outer spaces, judging is
    not.
    """
    missed = items.where("verdict IS NULL").select("key", "text").distinct()
    made = cascade.classify(missed, mode, toxic, junk, tox_model, spam_model, key="key")
    made = made.select(F.col("key").alias("made_key"), F.col("text").alias("made_text"), F.struct(*[F.col(c).alias(c) for c in VERDICT]).alias("made"))
    same = (F.when(F.col("verdict").isNull(), F.col("key")) == F.col("made_key")) & F.col("text").eqNullSafe(F.col("made_text"))
    rows = items.join(made, same, "left")
    verdict = F.coalesce("verdict", "made")
    return rows.select("task_id", "source", "sent_at", "item_index", "text", "ref", "key", F.col("verdict").isNotNull().alias("from_cache"), *[verdict[c].alias(c) for c in VERDICT])


def learnt(verdicts: DataFrame) -> DataFrame:
    """key, verdict (JSON), at, ttl_s: what is to be remembered of judged items, of a key the latest. Blank texts never are."""
    own = verdicts.where(~F.col("from_cache") & ~_blank(F.col("text")) & F.coalesce("tox_model_used", "spam_model_used").isNotNull())
    last = own.groupBy("key").agg(F.max_by(F.struct(*VERDICT), F.struct("sent_at", "task_id", "item_index")).alias("verdict"), F.max("sent_at").alias("at"))
    rules_only = F.coalesce(F.col("verdict.tox_model_used") == "regex", F.lit(False))
    return last.select("key", F.to_json("verdict").alias("verdict"), "at", F.when(rules_only, TTL_RULES).otherwise(TTL).alias("ttl_s"))


def _blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def _verdict_type() -> str:
    kinds = {"is_toxic": "boolean", "is_spam": "boolean", "toxicity_score": "double", "spam_score": "double"}
    return "struct<" + ", ".join(f"{c}: {kinds.get(c, 'string')}" for c in VERDICT) + ">"


LEARNT = "key string, verdict string, at timestamp, ttl_s int"
_ITEM = "struct<task_id: string, source: string, sent_at: timestamp, item_index: int, text: string, ref: struct<chat_id: bigint, message_id: bigint>>"


def results(verdicts: DataFrame) -> DataFrame:
    """Result messages: the verdicts of a task with their refs, in order."""
    fields = F.struct("item_index", "ref", *VERDICT)
    return verdicts.groupBy("task_id", "source").agg(F.to_json(F.array_sort(F.collect_list(fields))).alias("results"))


def moderate(
    messages: DataFrame, path: str, checkpoint: str, mode: str = "both", tox_model: Model | None = None, spam_model: Model | None = None,
    toxic: dict[str, str] = rules.TOXIC, junk: dict[str, str] = rules.SPAM, salts: int = SALTS,
):
    """Judges messages: looks texts up in the keyed verdict cache, judges the others, and saves items, verdicts and results under path.

    The cache is state of this query. What a micro-batch learns is written under path/learnt, which the query reads as its
    second stream, so the next micro-batch finds it. Lookups of a key are dealt over `salts` states, each told what is
    learnt. A replayed micro-batch writes its folders again. One that fails is written as failed tasks, its items with the
    error, and doesn't stop the stream.
    """
    spark = messages.sparkSession
    with_state_store(spark)
    spark.createDataFrame([], LEARNT).write.mode("append").parquet(f"{path}/learnt/batch=-1")  # the folder, for the stream to begin with
    stores = spark.readStream.schema(LEARNT).option("recursiveFileLookup", True).parquet(f"{path}/learnt")
    told = stores.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "*")
    told = told.select(F.concat_ws("#", "key", "salt").alias("key"), F.lit(None).cast("string").alias("asked"), "verdict", "ttl_s", F.col("at").cast("double").alias("at"))
    items = unpack(messages)
    drawn = F.pmod(F.xxhash64("task_id", "item_index"), F.lit(salts)).cast("string")
    spread = F.pmod(F.xxhash64("task_id", "item_index"), F.lit(4096)).cast("string")  # blank texts have no entry to meet at
    key = F.when(_blank(F.col("text")), F.concat(F.lit("blank#"), spread)).otherwise(F.concat_ws("#", "key", drawn))
    item = F.to_json(F.struct("task_id", "source", "sent_at", "item_index", "text", "ref"))
    asked = items.select(key.alias("key"), item.alias("asked"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("int").alias("ttl_s"), F.col("sent_at").cast("double").alias("at"))
    looked_up = verdict_cache(asked.unionByName(told)).select(F.from_json("asked", _ITEM).alias("item"), F.from_json("verdict", _verdict_type()).alias("verdict"))
    looked_up = looked_up.select("item.*", tx.cache_key(F.col("item.text")).alias("key"), "verdict")

    def work(batch: DataFrame, number: int) -> None:
        kept = scratch(spark, "batch")
        batch.write.parquet(kept)  # read back by all steps, so the sources are read once
        batch = spark.read.schema(batch.schema).parquet(kept)
        try:
            out = judged(batch, mode, tox_model, spam_model, toxic, junk)
            out.withColumn("error", F.lit(None).cast("string")).write.mode("overwrite").parquet(f"{path}/items/batch={number}")
            own = spark.read.parquet(f"{path}/items/batch={number}")
            learnt(own).write.mode("overwrite").parquet(f"{path}/learnt/batch={number}")
            results(own).write.mode("overwrite").json(f"{path}/results/batch={number}")
        except Exception as error:  # the failure is recorded for every task of the batch and its items
            why = F.lit(str(error)[:200])
            tasks = batch.select("task_id", F.lit("failed").alias("status"), why.alias("error")).distinct()
            tasks.write.mode("overwrite").json(f"{path}/failed/batch={number}")
            relational.fail_items(batch.drop("verdict").withColumn("error", F.lit(None).cast("string")), tasks).drop("ref").write.mode("overwrite").json(f"{path}/failed_items/batch={number}")

    # entries that are too old are never given out, so no micro-batch need run just to remove them
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    spark.conf.set(idle, "false")
    try:
        return looked_up.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(idle, before)


def saved_items(spark: SparkSession, path: str) -> DataFrame:
    """The items that moderate has judged, the latest micro-batch of each (task_id, item_index)."""
    rows = spark.read.option("basePath", f"{path}/items").parquet(f"{path}/items/batch=*")
    rest = [c for c in rows.columns if c not in ("task_id", "item_index")]
    return rows.groupBy("task_id", "item_index").agg(F.max_by(F.struct(*rest), "batch").alias("row")).select("task_id", "item_index", "row.*").drop("batch")


def updates(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Platform updates: new or edited messages with text, each update_id once, with chat, message and user in ref."""
    raw = spark.readStream.schema(UPDATE).json(path)
    return relational.accepted(raw).withWatermark("at", late).dropDuplicatesWithinWatermark(["update_id"])


def actions(verdicts: DataFrame) -> DataFrame:
    """Delete actions of verdicts on messages of the platform; stateless, for batch and stream."""
    return relational.actions(verdicts)


def with_state_store(spark: SparkSession) -> None:
    """Keyed state with timers and a time to live needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class CountOrAge(StatefulProcessor):
    """The open batch of a source: its items as a list that is only appended to, its first time, number and timer."""

    def __init__(self, size: int, seconds: float):
        self.size, self.seconds = size, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "key string")
        self.open = handle.getValueState("open", "n int, first double, batch long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, first, batch, timer = self.open.get() if self.open.exists() else (0, 0.0, 0, -1)
        own, closed = [], []
        for second, name in sorted((s, k) for pdf in rows for s, k in zip(pdf["second"], pdf["key"])):
            first = second if n == 0 else first
            own.append((name,))
            n += 1
            if n >= self.size or second - first >= self.seconds:
                closed.append((self._taken() if n > len(own) else []) + own)
                n, own = 0, []
                timer = self._stopped(timer)
        if own:
            self.items.appendList(own)
            if timer < 0:
                timer = timerValues.getCurrentProcessingTimeInMs() + int(self.seconds * 1000)
                self.handle.registerTimer(timer)
        self.open.update((n, float(first), batch + len(closed), timer))
        yield self._told(key, [(k, batch + i) for i, items in enumerate(closed) for (k,) in items])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, first, batch, _ = self.open.get()
        items = self._taken()
        self.open.update((0, first, batch + 1, -1))
        yield self._told(key, [(k, batch) for (k,) in items])

    def _taken(self) -> list[tuple]:
        """The items kept so far, and an empty list in their place."""
        items = list(self.items.get()) if self.items.exists() else []
        self.items.clear()
        return items

    def _stopped(self, timer: int) -> int:
        if timer >= 0:
            self.handle.deleteTimer(timer)
        return -1

    def _told(self, key, rows: list[tuple]) -> pd.DataFrame:
        names = pd.DataFrame({"source": [key[0]] * len(rows), "key": [k for k, _ in rows]}, dtype=object)
        return names.assign(batch=pd.Series([b for _, b in rows], dtype="int64"))

    def close(self) -> None:
        pass


def count_or_age(items: DataFrame, source: str, at: str, key: str, size: int, seconds: float) -> DataFrame:
    """source, key, batch of a stream's items, given out when their batch closes: at `size` items, or `seconds` after its first.

    The age is told by the items' times where an item shows it (that item is the batch's last, as in
    windows.micro_batches), and by a timer that the batch's first item sets where none comes.
    """
    with_state_store(items.sparkSession)
    rows = items.select(F.col(source).cast("string").alias("source"), F.col(at).cast("double").alias("second"), F.col(key).cast("string").alias("key"))
    return rows.groupBy("source").transformWithStateInPandas(CountOrAge(size, seconds), "source string, key string, batch long", "Append", "ProcessingTime")


class Verdicts(StatefulProcessor):
    """The cached verdict of a key. What rules alone gave lives in a state of its own, as it is kept for a shorter time."""

    def __init__(self, short: float, long: float):
        self.short, self.long = short, long

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = "verdict string, until double"
        self.states = [handle.getValueState(name, kind, ttlDurationMs=int(s * 1000)) for name, s in (("short", self.short), ("long", self.long))]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        verdict, until = next((s.get() for s in self.states if s.exists()), (None, 0.0))
        out, last = [], None
        for row in pd.concat(rows).sort_values(["at", "asked"], na_position="first").itertuples():
            if isinstance(row.verdict, str):
                verdict, until = last = row.verdict, float(row.at + row.ttl_s)
                where = 0 if row.ttl_s <= self.short else 1
            else:
                out.append((key[0], row.asked, verdict if verdict is not None and row.at < until else None))
        if last:
            self.states[1 - where].clear()
            self.states[where].update(last)
        yield pd.DataFrame(out, columns=["key", "asked", "verdict"], dtype=object)

    def close(self) -> None:
        pass


def verdict_cache(rows: DataFrame, short: float = TTL_RULES, long: float = TTL) -> DataFrame:
    """The verdict cache as keyed state. rows are stores (key, verdict, ttl_s, at) and lookups (key, asked, at; verdict null).

    Gives key, asked, verdict of every lookup: what was stored last, as long as it lives, else null. Rows of one trigger
    act in order of `at` (seconds), stores before lookups of the same time. An entry lives for its ttl_s by the rows'
    times; its state goes by itself, `short` or `long` seconds after the store, however often it is looked up.
    """
    with_state_store(rows.sparkSession)
    own = rows.select("key", F.col("asked").cast("string").alias("asked"), F.col("verdict").cast("string").alias("verdict"), F.col("ttl_s").cast("double").alias("ttl_s"), F.col("at").cast("double").alias("at"))
    return own.groupBy("key").transformWithStateInPandas(Verdicts(short, long), "key string, asked string, verdict string", "Append", "ProcessingTime")


def first_seen(items: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """Items whose key was not seen within the time to live, by event time sent_at."""
    return items.withWatermark("sent_at", ttl).dropDuplicatesWithinWatermark(["key"])
