"""Queries of task tables, timing logs, ordered computations, vocabularies, models and augmentation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions import text as tx
from ..operators import augment, corpus, logs, metrics, models, relational, windows
from ..sources import tables
from . import base
from .base import docs, query, table
from .data_queries import _TASKS, _V, _tasks, verdicts
from .text_queries import _FEATURE_SQL, S

_US = "epoch_us(ts)"


def _micros(column):
    return F.unix_micros(F.to_timestamp(column))


# events as log lines: component stage event wall task n ms
_LINE = "'component=' || event_type || ' stage=s' || (user_id % 5) || ' event=' || CASE WHEN event_id % 3 = 0 THEN 'start' ELSE 'end' END || ' task=' || user_id || ' n=' || (event_id % 10) || CASE WHEN event_id % 4 = 0 THEN '' ELSE ' ms=' || (value::DECIMAL(12, 2)) END || CASE WHEN event_type = 'view' THEN ' hits=' || (user_id % 4) || ' path=p' || (event_id % 3) ELSE '' END"


def _events_as_log(spark, d):
    """Timing lines from the events, as a log reader would see them."""
    e = table(spark, d, "events")
    line = F.concat(
        F.lit("component="), "event_type", F.lit(" stage=s"), (F.col("user_id") % 5).cast("string"), F.lit(" event="), F.when(F.col("event_id") % 3 == 0, "start").otherwise("end"),
        F.lit(" task="), F.col("user_id").cast("string"), F.lit(" n="), (F.col("event_id") % 10).cast("string"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit(" ms="), F.col("value").cast("decimal(12,2)").cast("string"))),
        F.when(F.col("event_type") == "view", F.concat(F.lit(" hits="), (F.col("user_id") % 4).cast("string"), F.lit(" path=p"), (F.col("event_id") % 3).cast("string"))).otherwise(""),
    )
    return e.select("event_id", line.alias("line"))


_PARSED = f"""SELECT event_id, regexp_extract(line, 'component=([^ ]+)', 1) AS component, regexp_extract(line, ' stage=([^ ]+)', 1) AS stage, regexp_extract(line, ' event=([^ ]+)', 1) AS event,
    try_cast(regexp_extract(line, ' task=([^ ]+)', 1) AS BIGINT) AS task, try_cast(regexp_extract(line, ' n=([^ ]+)', 1) AS BIGINT) AS n, try_cast(regexp_extract(line, ' ms=([0-9.]+)', 1) AS DOUBLE) AS ms,
    try_cast(regexp_extract(line, ' hits=([0-9]+)', 1) AS BIGINT) AS hits, nullif(regexp_extract(line, ' path=([^ ]+)', 1), '') AS path
    FROM (SELECT event_id, {_LINE} AS line FROM events)"""


@query(f"SELECT * REPLACE (coalesce(ms, -1) AS ms, coalesce(hits, -1) AS hits, coalesce(path, '') AS path) FROM ({_PARSED})")
def s08_parse_timing(spark, d):
    return logs.timing_lines(_events_as_log(spark, d)).withColumns({"ms": F.coalesce("ms", F.lit(-1.0)), "hits": F.coalesce("hits", F.lit(-1)), "path": F.coalesce("path", F.lit(""))})


_STATS = lambda v: f"count({v}) AS n, round(avg({v}), 6) AS mean, min({v}) AS least, max({v}) AS most, " + ", ".join(f"round(quantile_cont({v}, {p}), 6) AS {n}" for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (0.999, "p99_9")))


# events as classify lines: mode executor items wall tox spam; a side that a mode leaves out has no time
_CLASSIFY = "'mode=' || CASE event_type WHEN 'view' THEN 'both' WHEN 'click' THEN 'tox_only' ELSE 'spam_only' END || ' executor=' || event_type || ' items=' || (event_id % 100) || ' wall_ms=' || (value::DECIMAL(12, 2)) || CASE WHEN event_type IN ('view', 'click') THEN ' tox_ms=' || (event_id % 50 + 0.5) ELSE '' END || CASE WHEN event_type <> 'click' THEN ' spam_ms=' || (user_id % 30 + 0.25) ELSE '' END"
_CLASSIFIED = f"""SELECT event_id, regexp_extract(line, 'mode=([^ ]+)', 1) AS mode, regexp_extract(line, ' executor=([^ ]+)', 1) AS executor, try_cast(regexp_extract(line, ' items=([0-9]+)', 1) AS BIGINT) AS items,
    try_cast(regexp_extract(line, ' wall_ms=([0-9.]+)', 1) AS DOUBLE) AS wall_ms, try_cast(regexp_extract(line, ' tox_ms=([0-9.]+)', 1) AS DOUBLE) AS tox_ms, try_cast(regexp_extract(line, ' spam_ms=([0-9.]+)', 1) AS DOUBLE) AS spam_ms
    FROM (SELECT event_id, {_CLASSIFY} AS line FROM events)"""


def _classified(spark, d):
    e, ms = table(spark, d, "events"), lambda c: c.cast("decimal(12,2)").cast("string")
    kind = F.col("event_type")
    line = F.concat(
        F.lit("mode="), F.when(kind == "view", "both").when(kind == "click", "tox_only").otherwise("spam_only"), F.lit(" executor="), kind, F.lit(" items="), (F.col("event_id") % 100).cast("string"), F.lit(" wall_ms="), ms(F.col("value")),
        F.when(kind.isin("view", "click"), F.concat(F.lit(" tox_ms="), ((F.col("event_id") % 50).cast("string")), F.lit(".5"))).otherwise(""), F.when(kind != "click", F.concat(F.lit(" spam_ms="), ((F.col("user_id") % 30).cast("string")), F.lit(".25"))).otherwise(""),
    )
    return logs.classify_lines(e.select("event_id", line.alias("line")))


@query(f"SELECT * REPLACE (coalesce(tox_ms, -1) AS tox_ms, coalesce(spam_ms, -1) AS spam_ms) FROM ({_CLASSIFIED})")
def s09_parse_classify(spark, d):
    return _classified(spark, d).withColumns({c: F.coalesce(c, F.lit(-1.0)) for c in ("tox_ms", "spam_ms")})


@query(
    """WITH b AS (SELECT user_id AS batch, min(epoch_us(ts)) AS s, count(DISTINCT event_type) AS kinds, max(epoch_us(ts)) AS e FROM events GROUP BY user_id),
    i AS (SELECT user_id AS batch, (b.e - (b.s + (epoch_us(ts) - b.s) / 2 + 2000000)) / 1e6 AS latency FROM events JOIN b ON b.batch = user_id WHERE kinds > 1)
    SELECT batch, count(*) AS n, round(avg(latency), 4) AS mean, round(quantile_cont(latency, 0.95), 4) AS p95 FROM i WHERE latency >= 0 GROUP BY batch"""
)
def a27_intended_latency(spark, d):
    """A user's events as a batch: arrivals were planned at half their distance from the first, clocks are 2 s apart; users of one kind of event went to two tasks."""
    e = table(spark, d, "events").select("user_id", "event_type", _micros("ts").alias("us"))
    start = F.min("us").alias("start")
    users = e.groupBy("user_id").agg(start, F.max("us").alias("end"), F.collect_list("us").alias("all"), F.count_distinct("event_type").alias("kinds"))
    tasks = F.when(F.col("kinds") > 1, F.array("user_id")).otherwise(F.array("user_id", -F.col("user_id")))
    batches = users.select(F.col("user_id").alias("batch"), "start", tasks.alias("task_ids"), F.transform("all", lambda u: (u - F.col("start")) / 2e6).alias("arrivals"))
    late = relational.intended_latency(batches, users.select(F.col("user_id").alias("task_id"), (F.col("end") / 1e6).alias("completed")), F.col("start") / 1e6, 2.0)
    return late.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency"), 4).alias("mean"), F.round(F.percentile("latency", 0.95), 4).alias("p95"))


@query(f"SELECT component, stage, {_STATS('ms')} FROM ({_PARSED.replace(' n,', ' n_items,').replace('AS n,', 'AS n_items,')}) WHERE event = 'end' AND ms IS NOT NULL GROUP BY component, stage")
def a29_stage_durations(spark, d):
    rows = logs.timing_lines(_events_as_log(spark, d)).where("event = 'end' AND ms IS NOT NULL")
    return metrics.percentile_table(rows, ["component", "stage"], F.col("ms"))


@query(f"SELECT l_returnflag, {_STATS('l_extendedprice')} FROM lineitem GROUP BY l_returnflag")
def a20_percentiles(spark, d):
    return metrics.percentile_table(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"))


_LAT = f"SELECT task_id, epoch_us(completed_at) - epoch_us(created_at) AS us FROM ({_TASKS}) WHERE completed_at >= created_at"


@query(f"SELECT task_id, us::BIGINT AS us FROM ({_LAT})")
def a19_latency(spark, d):
    return _tasks(spark, d).where("completed_at >= created_at").select("task_id", (_micros("completed_at") - _micros("created_at")).alias("us"))


@query("SELECT n, round(n / (span / 1e6), 6) AS per_second FROM (SELECT count(*) AS n, max(epoch_us(ts)) - min(epoch_us(ts)) AS span FROM events)")
def a21_throughput(spark, d):
    out = table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), (F.max(_micros("ts")) - F.min(_micros("ts"))).alias("span"))
    return out.select("n", F.round(F.try_divide(F.col("n"), F.col("span") / 1e6), 6).alias("per_second"))


@query(
    """WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)
    SELECT count(*) AS n, round(count(*) / (max(hi - lo) * 0.8 / 1e6), 6) AS per_second FROM events, b WHERE epoch_us(ts) BETWEEN lo + (hi - lo) * 0.1 AND hi - (hi - lo) * 0.1"""
)
def a22_steady_throughput(spark, d):
    e = table(spark, d, "events").select(_micros("ts").alias("us"))
    bounds = F.broadcast(e.agg(F.min("us").alias("lo"), F.max("us").alias("hi")))  # one row
    span = F.col("hi") - F.col("lo")
    inside = e.join(bounds).where((F.col("us") >= F.col("lo") + span * 0.1) & (F.col("us") <= F.col("hi") - span * 0.1))
    return inside.agg(F.count(F.lit(1)).alias("n"), F.max(span).alias("span")).select("n", F.round(F.col("n") / (F.col("span") * 0.8 / 1e6), 6).alias("per_second"))


@query(
    """WITH r AS (SELECT event_type AS offered, user_id AS repeat, count(*)::DOUBLE AS achieved, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY event_type, user_id)
    SELECT offered, count(*) AS repeats, median(achieved) AS achieved, round(median(p50), 6) AS p50, round(median(p95), 6) AS p95, round(median(p99), 6) AS p99 FROM r GROUP BY offered"""
)
def a31_sweep_curve(spark, d):
    """Kinds of events as offered rates, users as repeats: of each rate the median over its repeats."""
    shares = [F.percentile("value", p).alias(f"p{n}") for n, p in ((50, 0.5), (95, 0.95), (99, 0.99))]
    points = table(spark, d, "events").groupBy(F.col("event_type").alias("offered"), F.col("user_id").alias("repeat")).agg(F.count(F.lit(1)).cast("double").alias("achieved"), *shares)
    return logs.sweep_curve(points, ["achieved", "p50", "p95", "p99"])


@query(
    f"""WITH h AS (SELECT conv_id AS task_id, count(DISTINCT lower(trim(text))) < count(*) AS has_dup FROM conversations GROUP BY conv_id),
    l AS (SELECT task_id, (epoch_us(completed_at) - epoch_us(created_at)) / 1e6 AS latency FROM ({_TASKS}) WHERE completed_at >= created_at)
    SELECT round(avg(latency) FILTER (NOT coalesce(has_dup, false)), 6) AS cold, round(avg(latency) FILTER (has_dup), 6) AS hot, round(avg(latency) FILTER (NOT coalesce(has_dup, false)) / avg(latency) FILTER (has_dup), 6) AS ratio FROM l LEFT JOIN h USING (task_id)"""
)
def a28_cold_hot(spark, d):
    """Latencies of tasks whose batch (a conversation) repeats a text, and of the others."""
    c = table(spark, d, "conversations")
    batches = c.groupBy(F.col("conv_id").alias("task_id")).agg((F.count_distinct(F.lower(F.trim("text"))) < F.count(F.lit(1))).alias("has_dup"))
    latencies = _tasks(spark, d).where("completed_at >= created_at").select("task_id", ((_micros("completed_at") - _micros("created_at")) / 1e6).alias("latency"))
    return relational.cold_hot(latencies, batches)


@query(
    f"""SELECT executor, count(*) AS n, round(avg(greatest(coalesce(tox_ms, 0), coalesce(spam_ms, 0))), 6) AS slower, round(max(greatest(coalesce(tox_ms, 0), coalesce(spam_ms, 0))), 6) AS most, round(avg(wall_ms), 6) AS wall, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes
    FROM ({_CLASSIFIED}) GROUP BY executor"""
)
def a30_classify_timing(spark, d):
    return logs.classify_stats(_classified(spark, d))


# ordered computations

_IV = "SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + (value * 1000000)::BIGINT AS b FROM events"


@query(f"SELECT user_id, max(open)::BIGINT AS peak FROM (SELECT user_id, sum(delta) OVER (PARTITION BY user_id ORDER BY moment RANGE UNBOUNDED PRECEDING) AS open FROM (SELECT user_id, a AS moment, 1 AS delta FROM ({_IV}) UNION ALL SELECT user_id, b, -1 FROM ({_IV}))) GROUP BY user_id")
def w02_peak_concurrency(spark, d):
    a = _micros("ts")
    rows = table(spark, d, "events").select("user_id", a.alias("a"), (a + F.round(F.col("value") * 1000000).cast("long")).alias("b"))
    return windows.peak_concurrency(rows, "user_id", "a", "b")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    following AS (SELECT user_id, k, least(k + 20, coalesce(1 + min(k) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 600000000 FOLLOWING AND UNBOUNDED FOLLOWING), k + 20)) AS after FROM e),
    starts AS (SELECT user_id, 1::BIGINT AS k, 0::BIGINT AS batch FROM e WHERE k = 1
      UNION ALL SELECT s.user_id, f.after, s.batch + 1 FROM starts s JOIN following f ON f.user_id = s.user_id AND f.k = s.k JOIN e ON e.user_id = f.user_id AND e.k = f.after)
    SELECT e.user_id, e.event_id, s.batch FROM e JOIN starts s ON e.user_id = s.user_id AND e.k >= s.k JOIN following f ON f.user_id = s.user_id AND f.k = s.k WHERE e.k < f.after"""
)
def w03_micro_batches(spark, d):
    e = table(spark, d, "events").select("user_id", (_micros("ts") / 1e6).alias("at"), "event_id")
    return windows.micro_batches(e, "user_id", "at", "event_id", 20, 600.0)


@query("SELECT source, doc_id, ntile(4) OVER (PARTITION BY source ORDER BY length(text), doc_id)::BIGINT AS part FROM documents")
def w04_length_groups(spark, d):
    return windows.length_groups(docs(spark, d), "source", F.length("text"), "doc_id", 4).select("source", "doc_id", "part")


@query("SELECT doc_id, greatest(0, least(7, floor((length(text) - 0) / 512.0)))::INT AS bucket FROM documents")
def w05_linear_buckets(spark, d):
    return docs(spark, d).select("doc_id", windows.linear_bucket(F.length("text"), 0, 4096, 8).alias("bucket"))


@query("""WITH e AS (SELECT unnest(quantile_cont(length(text), [0.25, 0.5, 0.75])) AS e FROM documents), r AS (SELECT round_even(e, 0) AS e FROM e)
    SELECT doc_id, (SELECT count(*) FROM r WHERE r.e <= length(d.text)) AS bucket FROM documents d""")
def w06_quantile_buckets(spark, d):
    rows = docs(spark, d).select("doc_id", F.length("text").alias("n"))
    edges = windows.quantile_edges(rows, "n", 4)
    return rows.select("doc_id", F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<int>"), lambda e: e <= F.col("n"))).cast("long").alias("bucket"))


_BB = "SELECT doc_id, source, n, (row_number() OVER (PARTITION BY source ORDER BY md5('epoch-1' || doc_id), doc_id) - 1) // 8 AS batch FROM (SELECT doc_id, source, length(text) AS n FROM documents)"


@query(f"SELECT doc_id, batch::BIGINT AS batch FROM ({_BB})")
def w07_bucket_batches(spark, d):
    return windows.bucket_batches(docs(spark, d).select("doc_id", "source"), "source", "doc_id", 8, "epoch-1").select("doc_id", "batch")


@query(
    """WITH b AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY md5('epoch-1-2' || doc_id), doc_id) - 1) // 8 AS batch, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT doc_id, batch::BIGINT AS batch, md5(concat_ws('|', 'epoch-1-2-turn', source, batch::VARCHAR)) AS turn FROM b WHERE (batch + 1) * 8 <= n"""
)
def w07_second_epoch(spark, d):
    """Another epoch: rows and batches are shuffled anew, batches that are not full are left out."""
    return windows.bucket_batches(docs(spark, d).select("doc_id", "source"), "source", "doc_id", 8, "epoch-1", 2, drop_last=True).select("doc_id", "batch", "turn")


@query(f"SELECT doc_id, (max(greatest(n, 1)) OVER (PARTITION BY source, batch) - greatest(n, 1))::BIGINT AS pad FROM ({_BB})")
def w08_padding(spark, d):
    rows = windows.bucket_batches(docs(spark, d).select("doc_id", "source", F.length("text").alias("n")), "source", "doc_id", 8, "epoch-1")
    return windows.padding(rows, ["source", "batch"], "n").select("doc_id", F.col("pad").cast("long").alias("pad"))


# messages and actions


@query("SELECT conv_id * 100 + turn AS update_id, text, conv_id AS chat_id, turn AS message_id, conv_id % 7 AS user_id FROM conversations WHERE trim(coalesce(text, '')) <> '' AND role <> 'system'")
def p10_accept_updates(spark, d):
    """Turns as updates: those of users are messages, those of the assistant edited ones, and system turns have neither."""
    c = table(spark, d, "conversations")
    m = F.struct("text", F.col("turn").alias("message_id"), F.struct(F.col("conv_id").alias("id")).alias("chat"), F.struct((F.col("conv_id") % 7).alias("id")).alias("from"))
    updates = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("update_id"), F.when(F.col("role") == "user", m).alias("message"), F.when(~F.col("role").isin("user", "system"), m).alias("edited_message"))
    return relational.accepted(updates).select("update_id", "text", "ref.*")


@query("SELECT conv_id, count(*) AS n, CASE WHEN count(*) BETWEEN 1 AND 5 THEN 'accepted' ELSE 'rejected' END AS state FROM conversations GROUP BY conv_id")
def p11_batch_size(spark, d):
    sizes = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("state", F.when(F.col("n").between(1, 5), "accepted").otherwise("rejected"))


@query(f"SELECT doc_id FROM ({_V}) WHERE tox_model_used IS NOT NULL OR spam_model_used IS NOT NULL")
def p14_cacheable(spark, d):
    return verdicts(spark, d, docs(spark, d).select("doc_id", "text")).where("text <> '' AND (tox_model_used IS NOT NULL OR spam_model_used IS NOT NULL)").select("doc_id")


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p01_null_text(spark, d):
    return docs(spark, d).select("doc_id", tx.clean(F.col("text")).alias("text"))


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) WHERE pos >= n // 4 AND pos < n // 2")
def p13_row_range(spark, d):
    """The second quarter of the rows: positions come from the id, never from arrival order."""
    rows = docs(spark, d).select("doc_id", "text")
    n = rows.count()
    return corpus.row_range(rows, "doc_id", n // 4, n // 2)


# vocabulary, weights and models: n-grams of the normalised texts of labelled documents

_NORM = base.sql_normalise("text")
_LABELLED_TEXTS = f"(SELECT doc_id, made FROM (SELECT doc_id, {_NORM} AS made FROM ({base.TOXIC_LABELS})) WHERE made <> '')"
_TF = base.sql_gram_counts(_LABELLED_TEXTS, "made")
_VOCAB = f"SELECT term, sum(tf)::BIGINT AS total, count(*) AS df FROM ({_TF}) GROUP BY term HAVING count(*) >= 5 AND count(*) <= 0.7 * (SELECT count(*) FROM {_LABELLED_TEXTS}) ORDER BY total DESC, term LIMIT 45000"


def _tf(spark, d):
    """The n-gram counts and the number of texts; both are kept, so texts are normalised and cut once."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = base.labelled(spark, d).select("doc_id", tx.normalise(F.col("text")).alias("made")).where("made <> ''").repartition(n, "doc_id")
    rows = models._kept(rows, "normalised")
    tf = tx.gram_counts(rows.repartition(n, "doc_id").withColumn("part", F.lit("all")), ["doc_id", "part"], F.col("made"), 3, 4)
    return models._kept(tf, "gram-counts"), rows.count()


_BUCKETS = 1 << 18


@query(_VOCAB)
def m01_vocabulary(spark, d):
    return models.vocabulary(*_tf(spark, d), min_df=5, max_df=0.7, buckets=_BUCKETS).drop("part")


@query(
    f"""WITH t AS (SELECT t.doc_id, t.term, (1 + ln(t.tf)) * (ln((1 + n) / (1 + v.df)::DOUBLE) + 1) AS w FROM ({_TF}) t JOIN ({_VOCAB}) v USING (term), (SELECT count(*)::DOUBLE AS n FROM {_LABELLED_TEXTS}))
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM t"""
)
def m02_tfidf(spark, d):
    tf, n = _tf(spark, d)
    w = models.weighted(tf, models.with_idf(models.vocabulary(tf, n, min_df=5, max_df=0.7, buckets=_BUCKETS), n))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return w.select("doc_id", "term", F.round(F.col("w") / norm, 6).alias("weight"))


@query(f"SELECT t.doc_id, t.term, round(t.tf / sum(t.tf) OVER (PARTITION BY t.doc_id), 6) AS weight FROM ({_TF}) t JOIN ({_VOCAB}) v USING (term)")
def m02_raw_shares(spark, d):
    """Raw counts without idf, by the l1 norm."""
    tf, n = _tf(spark, d)
    w = models.weighted(tf, models.with_idf(models.vocabulary(tf, n, min_df=5, max_df=0.7, buckets=_BUCKETS), n, use_idf=False), sublinear=False)
    norms = w.groupBy("doc_id").agg(models.norm_of(F.col("w"), "l1").alias("norm"))
    return w.join(norms, "doc_id").select("doc_id", "term", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))


_SCALED = [n for n in ft.NAMES if n not in ("repeated_chars_ratio", "has_phone")]  # those that the other engine can spell


@query(
    "WITH f AS (SELECT doc_id, " + ", ".join(f"{_FEATURE_SQL[k]} AS {k}" for k in _SCALED) + f" FROM (SELECT doc_id, {S} AS s FROM documents)) SELECT doc_id, "
    + ", ".join(f"round(({k} - avg({k}) OVER ()) / CASE WHEN stddev_pop({k}) OVER () = 0 THEN 1 ELSE stddev_pop({k}) OVER () END, 4) AS {k}" for k in _SCALED) + " FROM f"
)
def m03_scaling(spark, d):
    """All hand-made features less their mean, over their population deviation."""
    rows = models._kept(ft.with_features(base.spread(docs(spark, d)), "text", _SCALED, ["doc_id"]), "features")  # they are read twice
    return metrics.scaled(rows, _SCALED).select("doc_id", *[F.round(c, 4).alias(c) for c in _SCALED])


@query()
def m04_logistic_scores(spark, d):
    """A logistic model fitted and applied: balanced weights, penalty 1 / (C n)."""
    rows = base.labelled(spark, d)
    return models.score(models.fit(rows, c=1.0), rows)


@query(f"WITH {base.sql_bayes('tox', _NORM, base.TOXIC_LABELS)} SELECT l.doc_id, round(coalesce(p, 0), 6) AS score, coalesce(p, 0) >= 0.5 AS decided FROM ({base.TOXIC_LABELS}) l LEFT JOIN ({base.sql_bayes_scores('tox', f'({base.TOXIC_LABELS})', _NORM)}) USING (doc_id)")
def m05_naive_bayes(spark, d):
    rows = base.labelled(spark, d)
    return models.score_merged(models.fit_bayes(rows, alpha=1.0), rows)


@query()
def c05_tfidf_scores(spark, d):
    """The toxicity model applied to all documents, labelled or not, at the threshold best on the labelled ones."""
    rows = base.labelled(spark, d)
    return models.score(models.with_threshold(models.fit(rows), rows, 0.5), base.spread(docs(spark, d)), dealt=False)


@query()
def c06_spam_model(spark, d):
    """[TF-IDF | all 17 scaled features] of case-keeping texts; capitals rules first with score 1, their rows not learnt from."""
    return models.score(models.fit(base.spam_labelled(spark, d), "spam"), base.spread(docs(spark, d)), dealt=False)


@query()
def m07_saved_model(spark, d):
    """A model saved with its threshold, loaded and applied: decisions are by the saved threshold."""
    path = tables.scratch(spark, "saved-model")
    models.save(models.with_threshold(models.fit_bayes(base.labelled(spark, d)), base.labelled(spark, d), 0.5), path, preprocessing="normalise")
    model, _ = models.load(spark, path)
    return models.score(model, base.spread(docs(spark, d)), dealt=False)


@query()
def c14_batch_scorer(spark, d):
    return models.batch_scores(docs(spark, d), lambda texts: [len(t) / (1.0 + len(t)) for t in texts])


@query()
def a14_importance(spark, d):
    """Terms and hand-made features of the spam model, the two features of the small set among them."""
    return models.importance(models.fit(base.spam_labelled(spark, d), "spam", names=ft.MINIMAL))


@query()
def m06_search(spark, d):
    """Vocabulary sizes tried over two folds, by the best F1 at a precision of a half or more."""
    return models.search(base.labelled(spark, d), [{"size": 10_000}, {"size": 45_000, "min_df": 5, "max_df": 0.7}], folds=2, by="f1", floor=0.5)


@query()
def m06_search_bayes(spark, d):
    """Naive Bayes over idf, norms, counts, sizes and smoothing, all trials and folds in one pass."""
    trials = [{"alpha": 0.1}, {"alpha": 1.0, "norm": "l1"}, {"use_idf": False, "size": 10_000}, {"sublinear": False, "min_df": 5, "max_df": 0.7}]
    return models.search_bayes(base.spam_labelled(spark, d), trials, folds=2, floor=0.5)


@query()
def m06_search_fixed(spark, d):
    """Penalties tried on fixed validation rows, by average precision."""
    parts = corpus.split(base.labelled(spark, d), "label", "doc_id", {"train": 0.75, "val": 0.25})
    return models.search(parts.where("part = 'train'"), [{"c": 0.1}, {"c": 1.0}], val=parts.where("part = 'val'"))


# augmentation: noise drawn from a hash of seed and row


def _augmented(kind):
    def run(spark, d):
        made = augment.noise(docs(spark, d).select("doc_id", "text"), {"any": None, "keyboard": "qwerty"}.get(kind, kind), script=augment.LATIN)
        return made.select("doc_id", "text", "kind")

    run.__name__ = f"g_a_{kind}"
    query()(run)


for _kind in ("keyboard", "insert", "delete", "replace", "leet", "combined", "any"):
    _augmented(_kind)


@query()
def g_a8_augment_dataset(spark, d):
    return augment.dataset(base.labelled(spark, d).select("doc_id", "text", "label"), script=augment.LATIN)


@query("SELECT kind, count(*) AS n FROM (SELECT 'original' AS kind FROM documents) GROUP BY kind")
def g_a8_originals(spark, d):
    """The originals of an augmented table are the table."""
    rows = docs(spark, d).select("doc_id", "text", F.lit(1).alias("label"))
    return augment.dataset(rows, script=augment.LATIN).where("kind = 'original'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
