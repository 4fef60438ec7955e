"""Queries of classification, joins, sets, splits and nested data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions import rules
from ..functions import text as tx
from ..operators import cascade, corpus, relational, rule_table
from . import base
from .base import LABELLED, docs, labelled, query, quote, table

L = base.LATIN
_CAPS = f"(regexp_matches(coalesce(text, ''), {quote(ft.CAPS_WORD)}) OR regexp_matches(coalesce(text, ''), {quote(ft.CAPS_SHOUT)}))"
_HIT, _SPAM_HIT = base.sql_any("text"), base.sql_any("text", rules.SPAM)


def _sql_verdicts(source: str) -> str:
    """Both verdicts over a table with doc_id and text: rules, then the model on what they miss."""
    return f"""WITH {base.sql_bayes("tox", base.sql_normalise("text"), base.TOXIC_LABELS)}, {base.sql_bayes("spam", base.sql_spam("text"), base.SPAM_LABELS)},
    tox_p AS ({base.sql_bayes_scores("tox", f"(SELECT DISTINCT * FROM {source})", base.sql_normalise("text"))}),
    spam_p AS ({base.sql_bayes_scores("spam", f"(SELECT DISTINCT * FROM {source})", base.sql_spam("text"))}),
    e AS (SELECT doc_id, coalesce(text, '') AS text, {base.sql_strip("coalesce(text, '')")} = '' AS blank, {_HIT} AS hit, {base.sql_names('text', L)} AS types, {_SPAM_HIT} AS shit, {_CAPS} AS caps FROM {source}),
    s AS (SELECT e.*, CASE WHEN hit THEN 1.0 WHEN blank THEN 0.0 ELSE coalesce(t.p, 0.0) END AS score, CASE WHEN shit OR caps THEN 1.0 WHEN blank THEN 0.0 ELSE coalesce(s.p, 0.0) END AS sscore
      FROM e LEFT JOIN tox_p t USING (doc_id) LEFT JOIN spam_p s USING (doc_id))
    SELECT doc_id, text <> '' AND score >= 0.5 AS is_toxic, CASE WHEN text = '' THEN 0.0 ELSE round(score, 6) END AS toxicity_score, CASE WHEN hit THEN types ELSE '' END AS toxicity_types,
      CASE WHEN text = '' THEN NULL WHEN hit THEN 'regex' ELSE 'tfidf' END AS tox_model_used, text <> '' AND sscore >= 0.5 AS is_spam,
      CASE WHEN text = '' THEN 0.0 ELSE round(sscore, 6) END AS spam_score, CASE WHEN text = '' THEN NULL WHEN shit THEN 'regex' ELSE 'tfidf' END AS spam_model_used FROM s"""


def verdicts(spark, d, df, mode="both"):
    tox, spam = base.fitted(spark, d, mode)
    out = cascade.classify(base.spread(df), mode, L, tox_model=tox, spam_model=spam)
    return out.withColumns({c: F.round(c, 6) for c in ("toxicity_score", "spam_score")})


@query("WITH c AS (SELECT doc_id, " + base.sql_names("text", L) + " AS categories FROM documents) SELECT doc_id, categories, categories <> '' AS hit, CASE WHEN categories <> '' THEN 1.0 ELSE 0.0 END AS score FROM c")
def c01_rule_classifier(spark, d):
    out = base.spread(docs(spark, d)).select("doc_id", rules.names(rules.categories(F.col("text"), L)).alias("categories"))
    return out.select("*", (F.col("categories") != "").alias("hit"), F.when(F.col("categories") != "", 1.0).otherwise(0.0).alias("score"))


# the tables hold no Cyrillic: frequent words of theirs stand for words of ours, in several cases and neighbourhoods
_CYRILLIC = {
    " the ": " идиот ", " of ": " ХЕР.", " de ": " говна ", " que ": " пиздеж ", " der ": " схема  заработка ", " la ": " без вложений ", " and ": " подпись на канал ", " en ": " жмите тут: link\n",
    " to ": " зарабатывай! ", " in ": " халтура", " und ": " Трах\u00a0", " die ": " перебляди ", " el ": " бонус за регистрацию ", " et ": " вывод на карту ", " a ": " хер\u0456 ", " is ": " пиши в лс ",
}


def _planted(column):
    for k, v in _CYRILLIC.items():
        column = F.replace(column, F.lit(k), F.lit(v))
    return column


_PLANTED = "text"
for _k, _v in _CYRILLIC.items():
    _PLANTED = f"replace({_PLANTED}, {quote(_k)}, {quote(_v)})"


@query(f"SELECT doc_id, {base.sql_names('text', rules.TOXIC)} AS categories FROM (SELECT doc_id, {_PLANTED} AS text FROM documents)")
def c02_toxic_rules(spark, d):
    return base.spread(docs(spark, d)).select("doc_id", rules.names(rules.categories(_planted(F.col("text")), rules.TOXIC)).alias("categories"))


@query(f"SELECT doc_id, {base.sql_names('text', rules.SPAM)} AS categories FROM (SELECT doc_id, {_PLANTED} AS text FROM documents)")
def c03_spam_rules(spark, d):
    return base.spread(docs(spark, d)).select("doc_id", rules.names(rules.categories(_planted(F.col("text")), rules.SPAM)).alias("categories"))


_PHRASE = "[A-Za-z]+ [A-Za-z]+ [A-Za-z]+"


@query(
    f"""WITH r AS (SELECT item_id, lower(regexp_extract(text, '{_PHRASE}')) AS phrase FROM benchmark WHERE regexp_matches(text, '{_PHRASE}'))
    SELECT doc_id, coalesce(string_agg(DISTINCT r.item_id::VARCHAR, ',' ORDER BY r.item_id::VARCHAR), '') AS items FROM documents d LEFT JOIN r ON contains(lower(coalesce(d.text, '')), r.phrase) GROUP BY doc_id"""
)
def c01_rule_table(spark, d):
    """A table of rules made from the benchmark: the first three plain words of each item; which items' rules hit each document."""
    items = table(spark, d, "benchmark").where(F.col("text").rlike(_PHRASE))
    own = items.select(F.col("item_id").cast("string").alias("name"), F.regexp_extract("text", _PHRASE, 0).alias("pattern"))
    return rule_table.matched(base.spread(docs(spark, d)).select("doc_id", "text"), own).select("doc_id", F.array_join("hits", ",").alias("items"))


@query("SELECT doc_id, " + ", ".join(f"CASE WHEN {base.sql_hit('text', p)} THEN 1 ELSE 0 END AS {k}" for k, p in L.items()) + f", CASE WHEN {_HIT} THEN 1 ELSE 0 END AS any_hit FROM documents")
def c04_wide_flags(spark, d):
    out = base.spread(docs(spark, d)).select("doc_id", *[F.when(rules.hits(F.col("text"), p), 1).otherwise(0).alias(k) for k, p in L.items()])
    return out.withColumn("any_hit", F.greatest(*L))


_TOX_COLS = "doc_id, is_toxic, toxicity_score, toxicity_types, tox_model_used"
_SPAM_COLS = "doc_id, is_spam, spam_score, spam_model_used"
_V = _sql_verdicts("documents")


@query(f"SELECT {_TOX_COLS} FROM ({_V})")
def c08_toxicity_cascade(spark, d):
    return verdicts(spark, d, docs(spark, d), "tox_only").select(*_TOX_COLS.split(", "))


@query(f"SELECT {_SPAM_COLS} FROM ({_V})")
def c09_spam_cascade(spark, d):
    return verdicts(spark, d, docs(spark, d), "spam_only").select(*_SPAM_COLS.split(", "))


@query(
    f"""WITH v AS (SELECT * FROM ({_V})), t AS (SELECT v.* FROM v JOIN labels USING (doc_id)), s AS (SELECT v.* FROM v JOIN documents d USING (doc_id) WHERE d.lang = 'en')
    SELECT d.doc_id, coalesce(t.is_toxic, false) AS is_toxic, coalesce(t.toxicity_score, 0) AS toxicity_score, t.tox_model_used, coalesce(s.is_spam, false) AS is_spam, coalesce(s.spam_score, 0) AS spam_score, s.spam_model_used
    FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)"""
)
def c10_merge_verdicts(spark, d):
    """Sides judged apart: toxicity where there is a label, spam in English; where one is missing it is a stub."""
    rows = table(spark, d, "documents").select("doc_id", "text", "lang")
    tox = verdicts(spark, d, rows.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi"), "tox_only")
    spam = verdicts(spark, d, rows.where("lang = 'en'"), "spam_only")
    return cascade.merge(rows.select("doc_id"), tox, spam, "doc_id").drop("toxicity_types")


@query(_V)
def c11_moderate(spark, d):
    return verdicts(spark, d, docs(spark, d).select("doc_id", "text")).drop("text")


@query(f"SELECT doc_id, is_toxic, toxicity_score, toxicity_types, tox_model_used, false AS is_spam, 0.0::DOUBLE AS spam_score, NULL::VARCHAR AS spam_model_used FROM ({_V})")
def c11_moderate_tox_only(spark, d):
    return verdicts(spark, d, docs(spark, d).select("doc_id", "text"), "tox_only").drop("text")


_ATTEMPTS = """SELECT event_id // 4 AS msg, ['tfidf', 'bert', 'rnn', 'regex'][(event_id % 4 + 1)::INT] AS model, round(value / 100, 6) AS score,
    CASE WHEN event_type = 'error' OR user_id % 7 = 0 THEN 'failed' END AS error, (event_id * 37 % 100) / 100.0::DOUBLE AS elapsed FROM events"""


def _attempts(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.expr("event_id div 4").alias("msg"), F.element_at(F.array(*[F.lit(m) for m in cascade.CHAIN]), (F.col("event_id") % 4 + 1).cast("int")).alias("model"),
        F.round(F.col("value") / 100, 6).alias("score"), F.when((F.col("event_type") == "error") | (F.col("user_id") % 7 == 0), "failed").alias("error"),
        ((F.col("event_id") * 37 % 100) / 100.0).alias("elapsed"),
    )


@query(
    f"""SELECT msg, model, score FROM (SELECT *, row_number() OVER (PARTITION BY msg ORDER BY list_position(['rnn', 'tfidf', 'bert', 'regex'], model)) AS rn
    FROM ({_ATTEMPTS}) WHERE error IS NULL AND elapsed <= CASE model WHEN 'regex' THEN 0.05 WHEN 'tfidf' THEN 0.1 WHEN 'rnn' THEN 0.5 ELSE 1.0 END) WHERE rn = 1"""
)
def c12_fallback(spark, d):
    return cascade.fallback(_attempts(spark, d), "rnn")


@query(
    f"""SELECT model, errors, successes, errors > 10 AND successes > 0 AND errors::DOUBLE / (errors + successes) > 0.5 AS skipped
    FROM (SELECT model, count(error) AS errors, count(*) - count(error) AS successes FROM ({_ATTEMPTS}) GROUP BY model)"""
)
def c13_health(spark, d):
    return cascade.health(_attempts(spark, d))


@query("SELECT vec_id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS one_head, round(1 / (1 + exp(embedding[1]::DOUBLE - embedding[2]::DOUBLE)), 6) AS two_heads FROM embeddings")
def c15_logits(spark, d):
    a, b = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return table(spark, d, "embeddings").select("vec_id", F.round(1 / (1 + F.exp(-a)), 6).alias("one_head"), F.round(1 / (1 + F.exp(a - b)), 6).alias("two_heads"))


@query("SELECT vec_id, round(CASE WHEN label % 2 = 1 THEN p ELSE 1 - p END, 6) AS positive FROM (SELECT vec_id, label, 1 / (1 + exp(-embedding[1]::DOUBLE)) AS p FROM embeddings)")
def c16_positive_probability(spark, d):
    p = 1 / (1 + F.exp(-F.col("embedding")[0].cast("double")))
    named = F.concat(F.lit("__label__"), (F.col("label") % 2).cast("string"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.when(named.endswith("1"), p).otherwise(1 - p), 6).alias("positive"))


# joins. Tasks are conversations, items their turns; the cache holds verdicts of benchmark passages and of half the documents.

_TASKS = """SELECT user_id AS task_id, min(ts) AS created_at, max(ts) AS completed_at, CASE max(event_id) % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'queued' ELSE 'failed' END AS status
    FROM events GROUP BY user_id"""
_ITEMS = "SELECT conv_id AS task_id, turn AS item_index, role, text FROM conversations"


def _tasks(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("task_id")).agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("completed_at"),
        F.when(F.max("event_id") % 3 == 0, "completed").when(F.max("event_id") % 3 == 1, "queued").otherwise("failed").alias("status"),
    )


def _items(spark, d):
    return table(spark, d, "conversations").selectExpr("conv_id AS task_id", "turn AS item_index", "role", "text")


@query(f"SELECT t.task_id, t.status, i.item_index, i.role FROM ({_TASKS}) t JOIN ({_ITEMS}) i USING (task_id)")
def j01_tasks_items(spark, d):
    return _tasks(spark, d).join(_items(spark, d), "task_id").select("task_id", "status", "item_index", "role")


# the cache: verdicts of benchmark passages and of the documents of two sources, some long ago
_CACHE = """SELECT sha256(lower(trim(text))) AS key, 'passage' AS verdict, TIMESTAMP '2024-01-01 00:10:00' AS cached_at, 3600 AS ttl_s FROM benchmark UNION ALL
    SELECT sha256(lower(trim(text))), lang, TIMESTAMP '2024-01-01' + to_seconds(length(text)), CASE WHEN lang = 'en' THEN 300 ELSE 3600 END FROM documents WHERE source IN (SELECT min(source) FROM documents UNION ALL SELECT max(source) FROM documents)"""
_LOOKUP = f"""SELECT d.doc_id, d.doc_id // 10 AS task_id, c.verdict FROM documents d LEFT JOIN
    (SELECT key, arg_max(verdict, (cached_at, verdict)) AS verdict FROM ({_CACHE}) WHERE cached_at + to_seconds(ttl_s) > TIMESTAMP '2024-01-01 00:15:00' GROUP BY key) c
    ON trim(coalesce(d.text, '')) <> '' AND c.key = sha256(lower(trim(d.text)))"""


def _looked_up(spark, d):
    key = F.sha2(F.lower(F.trim("text")), 256)
    rows = docs(spark, d)
    whole = table(spark, d, "documents")
    ends = F.broadcast(whole.agg(F.min("source").alias("lo"), F.max("source").alias("hi")))  # one row
    old = whole.join(ends).where("source IN (lo, hi)").select(
        key.alias("key"), F.col("lang").alias("verdict"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, length(text))").alias("cached_at"), F.when(F.col("lang") == "en", 300).otherwise(3600).alias("ttl_s"),
    )
    passages = table(spark, d, "benchmark").select(key.alias("key"), F.lit("passage").alias("verdict"), F.expr("timestamp_ntz'2024-01-01 00:10:00'").alias("cached_at"), F.lit(3600).alias("ttl_s"))
    cache = old.unionByName(passages)
    items = rows.select("doc_id", F.expr("doc_id div 10").alias("task_id"), "text", key.alias("key"))
    return relational.cache_lookup(items, cache, F.expr("timestamp_ntz'2024-01-01 00:15:00'")).select("doc_id", "task_id", "text", "verdict")


@query(f"SELECT doc_id, verdict FROM ({_LOOKUP})")
def j02_cache_lookup(spark, d):
    return _looked_up(spark, d).select("doc_id", "verdict")


@query(
    f"""SELECT doc_id, CASE WHEN hits = n THEN 'all_hit' WHEN hits = 0 THEN 'all_miss' ELSE 'partial' END AS "case", CASE WHEN verdict IS NOT NULL THEN 'completed' ELSE 'queued' END AS part
    FROM (SELECT *, count(verdict) OVER (PARTITION BY task_id) AS hits, count(*) OVER (PARTITION BY task_id) AS n FROM ({_LOOKUP}))"""
)
def j03_split_batches(spark, d):
    return relational.split_batches(_looked_up(spark, d)).select("doc_id", "case", "part")


@query(
    f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY doc_id) AS rk, count(*) OVER (PARTITION BY task_id) AS n FROM ({_LOOKUP}) WHERE verdict IS NULL),
    r AS (SELECT l.doc_id, l.task_id, 'answer ' || l.doc_id AS verdict FROM ({_LOOKUP}) l JOIN documents d USING (doc_id) WHERE l.verdict IS NULL AND trim(coalesce(d.text, '')) <> ''),
    q AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY doc_id) AS rk, count(*) OVER (PARTITION BY task_id) AS n FROM r)
    SELECT m.task_id, m.doc_id, q.verdict AS answer FROM m JOIN q USING (task_id, rk, n)"""
)
def j04_realign(spark, d):
    """Answers come for the misses that have a text; a batch that misses one has another count and is left out."""
    found = _looked_up(spark, d)
    results = found.where("verdict IS NULL AND trim(coalesce(text, '')) <> ''").select("doc_id", "task_id", F.concat(F.lit("answer "), F.col("doc_id").cast("string")).alias("verdict"))
    return relational.realign(found.select("doc_id", "task_id", "verdict"), results, order="doc_id")


_ARRAYS = "SELECT conv_id, array_agg(turn ORDER BY turn) AS turns, array_agg(length(text) ORDER BY turn) AS score FROM conversations WHERE role = 'assistant' GROUP BY conv_id"


@query(f"SELECT c.conv_id, c.turn, coalesce(u.score, 0)::BIGINT AS score FROM conversations c LEFT JOIN (SELECT conv_id, unnest(turns) AS turn, unnest(score) AS score FROM ({_ARRAYS})) u USING (conv_id, turn)")
def j05_bulk_update(spark, d):
    rows = table(spark, d, "conversations")
    arrays = _column_arrays(rows.where("role = 'assistant'"))
    updates = arrays.select("conv_id", F.inline(F.arrays_zip("turn", "score")))
    return rows.select("conv_id", "turn").join(updates, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("score", F.lit(0)).cast("long").alias("score"))


def _column_arrays(rows):
    """Column arrays per task in index order."""
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("score")))).alias("l"))
    return listed.select("conv_id", F.transform("l", lambda x: x["turn"]).alias("turn"), F.transform("l", lambda x: x["score"]).alias("score"))


@query("SELECT conv_id, array_to_string(list(turn ORDER BY turn), ',') AS turns, array_to_string(list(length(text) ORDER BY turn), ',') AS scores FROM conversations GROUP BY conv_id")
def a33_column_arrays(spark, d):
    out = _column_arrays(table(spark, d, "conversations"))
    return out.select("conv_id", F.array_join(F.col("turn").cast("array<string>"), ",").alias("turns"), F.array_join(F.col("score").cast("array<string>"), ",").alias("scores"))


@query("SELECT event_id % 500 AS task_id, arg_max(user_id, event_id) AS user_id, max(event_id) AS updated_at FROM events GROUP BY event_id % 500")
def j06_upsert(spark, d):
    e = table(spark, d, "events").selectExpr("event_id % 500 AS task_id", "user_id", "event_id AS updated_at")
    half = F.col("updated_at") % 2 == 0
    return relational.upsert(e.where(half), e.where(~half), ["task_id"])


@query(f"SELECT task_id, item_index, role FROM ({_ITEMS}) WHERE task_id NOT IN (SELECT task_id FROM ({_TASKS}) WHERE status = 'failed')")
def j07_cascade_delete(spark, d):
    gone = _tasks(spark, d).where("status = 'failed'")
    return relational.cascade_delete([_items(spark, d)], gone, "task_id")[0].select("task_id", "item_index", "role")


@query(
    f"""WITH u AS (SELECT user_id AS task_id, arg_max(CASE event_type WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END, event_id) AS s, max(event_id) AS at
    FROM events WHERE event_type <> 'view' GROUP BY user_id),
    t AS (SELECT DISTINCT user_id AS task_id FROM events)
    SELECT t.task_id, coalesce(u.s, 'queued') AS status, CASE WHEN u.s IN ('completed', 'failed') THEN u.at ELSE -1 END AS completed_at, CASE WHEN u.s = 'failed' THEN 'stopped' END AS error,
      coalesce(string_agg(CASE WHEN u.s = 'failed' THEN i.item_index || ':stopped' END, ',' ORDER BY i.item_index), '') AS failed_items
    FROM t LEFT JOIN u USING (task_id) LEFT JOIN ({_ITEMS}) i ON i.task_id = t.task_id GROUP BY t.task_id, u.s, u.at"""
)
def j08_transitions(spark, d):
    """The last status that is no view counts; a failed task hands its error to all its items."""
    e = table(spark, d, "events")
    tasks = e.select(F.col("user_id").alias("task_id")).distinct().select("task_id", F.lit("queued").alias("status"), F.lit(0).alias("created_at"), F.lit(None).cast("long").alias("completed_at"))
    status = F.when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    updates = e.where("event_type <> 'view'").select(F.col("user_id").alias("task_id"), status.alias("status"), F.col("event_id").alias("at"), F.lit("stopped").alias("error"))
    moved = relational.transition(tasks, updates)
    items = relational.fail_items(_items(spark, d).withColumn("error", F.lit(None).cast("string")), moved).where("error IS NOT NULL")
    listed = items.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("item_index", "error"))).alias("l"))
    lines = F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["item_index"].cast("string"), x["error"])), ",")
    out = moved.join(listed.select("task_id", lines.alias("failed_items")), "task_id", "left")
    return out.select("task_id", "status", F.coalesce("completed_at", F.lit(-1)).alias("completed_at"), "error", F.coalesce("failed_items", F.lit("")).alias("failed_items"))


@query(f"SELECT 'missing' AS status, count(*) AS n FROM (SELECT DISTINCT conv_id AS task_id FROM conversations) c ANTI JOIN ({_TASKS}) t USING (task_id) UNION ALL SELECT status, count(*) AS n FROM ({_TASKS}) WHERE status <> 'completed' GROUP BY status")
def j09_unfinished(spark, d):
    tasks = _tasks(spark, d)
    missing = table(spark, d, "conversations").select(F.col("conv_id").alias("task_id")).distinct().join(tasks, "task_id", "left_anti").agg(F.lit("missing").alias("status"), F.count(F.lit(1)).alias("n"))
    return missing.unionByName(tasks.where("status <> 'completed'").groupBy("status").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT doc_id, 'original' AS kind FROM documents UNION ALL SELECT item_id, 'generated' FROM benchmark")
def j11_union_generated(spark, d):
    return docs(spark, d).select("doc_id", F.lit("original").alias("kind")).unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("generated").alias("kind")))


# stored verdicts: the cascade over the turns of conversations. As stores go wrong, verdicts of system turns lost their model,
# those of texts over 2000 characters were scaled, and blank texts have none.
_KEYED = "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"
_STORED = f"""SELECT c.conv_id AS task_id, c.turn AS item_index, c.role, c.text, c.conv_id % 7 AS user_id, CASE WHEN trim(coalesce(c.text, '')) <> '' THEN v.is_toxic END AS is_toxic,
    CASE WHEN length(c.text) > 2000 THEN v.toxicity_score * 10 ELSE v.toxicity_score END AS toxicity_score, v.toxicity_types, CASE WHEN c.role <> 'system' THEN v.tox_model_used END AS tox_model_used,
    v.is_spam, v.spam_score, v.spam_model_used, CASE WHEN trim(coalesce(c.text, '')) = '' THEN 'blank' END AS error, c.text IN (SELECT text FROM documents) AS from_cache
    FROM conversations c JOIN ({_sql_verdicts(_KEYED)}) v ON v.doc_id = c.conv_id * 1000 + c.turn"""


def stored(spark, d):
    c = table(spark, d, "conversations")
    own = F.expr("conv_id * 1000 + turn")
    v = verdicts(spark, d, c.select(own.alias("doc_id"), "text"))
    known = F.broadcast(docs(spark, d).select(F.col("text").alias("known")).join(c.select("text"), F.col("known") == F.col("text"), "left_semi").distinct())  # at most the turns' texts
    rows = c.join(v.drop("text"), own == F.col("doc_id")).join(known, F.col("text") == F.col("known"), "left")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return rows.select(
        F.col("conv_id").alias("task_id"), F.col("turn").alias("item_index"), "role", "text", (F.col("conv_id") % 7).alias("user_id"), F.when(~blank, F.col("is_toxic")).alias("is_toxic"),
        F.when(F.length("text") > 2000, F.col("toxicity_score") * 10).otherwise(F.col("toxicity_score")).alias("toxicity_score"), "toxicity_types", F.when(F.col("role") != "system", F.col("tox_model_used")).alias("tox_model_used"),
        "is_spam", "spam_score", "spam_model_used", F.when(blank, "blank").alias("error"), F.col("known").isNotNull().alias("from_cache"),
    )


@query(
    f"""SELECT t.task_id, t.status, CASE WHEN t.status IN ('completed', 'failed') THEN coalesce(r.results, '') END AS results, CASE WHEN t.status = 'failed' THEN r.error END AS error, coalesce(r.user_id, -1) AS user_id FROM ({_TASKS}) t
    LEFT JOIN (SELECT task_id, string_agg(item_index || ':' || coalesce(is_toxic, false) || ':' || coalesce(is_spam, false), ',' ORDER BY item_index) AS results, arg_min(user_id, item_index) AS user_id,
      first(error ORDER BY item_index) AS error FROM ({_STORED}) GROUP BY task_id) r USING (task_id)"""
)
def a32_read_model(spark, d):
    out = relational.read_model(_tasks(spark, d), stored(spark, d))
    line = F.transform("results", lambda r: F.concat_ws(":", r["item_index"].cast("string"), r["is_toxic"].cast("string"), r["is_spam"].cast("string")))
    return out.select("task_id", "status", F.when(F.col("results").isNotNull(), F.array_join(line, ",")).alias("results"), "error", F.coalesce("user_id", F.lit(-1)).alias("user_id"))


_BAD = {
    "tox": "(is_toxic IS NULL)::INT + (toxicity_score IS NULL OR toxicity_score < 0 OR toxicity_score > 1)::INT + (tox_model_used IS NULL AND (coalesce(is_toxic, false) OR coalesce(toxicity_score, 0) <> 0))::INT",
    "spam": "(is_spam IS NULL)::INT + (spam_score IS NULL OR spam_score < 0 OR spam_score > 1)::INT + (spam_model_used IS NULL AND (coalesce(is_spam, false) OR coalesce(spam_score, 0) <> 0))::INT",
}


@query(f"SELECT task_id, item_index, ({_BAD['tox']})::BIGINT AS bad_tox, ({_BAD['spam']})::BIGINT AS bad_spam FROM ({_STORED})")
def p12_validity(spark, d):
    return stored(spark, d).select("task_id", "item_index", *[relational.faults(s).cast("long").alias(f"bad_{s}") for s in ("tox", "spam")])


@query(f"SELECT t.task_id, t.status, r.* EXCLUDE (task_id) FROM ({_TASKS}) t JOIN (SELECT task_id, count(*) AS n, sum({_BAD['tox']})::BIGINT AS bad_tox, sum({_BAD['spam']})::BIGINT AS bad_spam, count(error) AS err FROM ({_STORED}) GROUP BY task_id) r USING (task_id)")
def a25_validity_report(spark, d):
    return relational.validity(_tasks(spark, d), stored(spark, d))


@query(f"SELECT role, count(*) AS n, count(*) FILTER (from_cache) AS hits, round(count(*) FILTER (from_cache)::DOUBLE / count(*), 6) AS rate FROM ({_STORED}) GROUP BY role")
def a23_hit_rate(spark, d):
    return stored(spark, d).groupBy("role").agg(*relational.cache_stats())


@query(f"SELECT side, arg_min(model, (-n, model)) AS model, max(n) AS n FROM (SELECT side, model, count(*) AS n FROM (SELECT 'tox' AS side, tox_model_used AS model FROM ({_STORED}) UNION ALL SELECT 'spam', spam_model_used FROM ({_STORED})) WHERE model IS NOT NULL GROUP BY side, model) GROUP BY side")
def a24_dominant_model(spark, d):
    return relational.dominant_models(stored(spark, d))


@query(f"SELECT task_id AS chat_id, item_index AS message_id, 'delete' AS action FROM ({_STORED}) WHERE role = 'user' AND trim(coalesce(text, '')) <> '' AND (is_toxic OR is_spam)")
def p09_actions(spark, d):
    """Turns of users come from the platform and name chat and message, if they have a text; flagged ones are deleted."""
    named = F.trim(F.coalesce("text", F.lit(""))) != ""
    ref = F.struct(F.when(named, F.col("task_id")).alias("chat_id"), F.when(named, F.col("item_index")).alias("message_id"))
    return relational.actions(stored(spark, d).withColumns({"source": F.when(F.col("role") == "user", "telegram").otherwise("api"), "ref": ref}))


# distinct, splits, samples


@query("SELECT DISTINCT text, source FROM documents")
def d01_distinct_rows(spark, d):
    return docs(spark, d).select("text", "source").dropDuplicates()


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def d02_distinct_text(spark, d):
    return corpus.distinct_on(docs(spark, d).select("doc_id", "text"), F.col("text"), "doc_id")


@query(f"SELECT arg_min(doc_id, doc_id) AS doc_id, arg_min(text, doc_id) AS text FROM documents GROUP BY lower({base.sql_strip(chr(116) + 'ext')})")
def d03_distinct_key(spark, d):
    return corpus.distinct_on(docs(spark, d).select("doc_id", "text"), F.lower(tx.strip(F.col("text"))), "doc_id")


_DRAW = "('0x' || substr(md5('split-1' || o_orderkey), 1, 8))::BIGINT"
_RANK = f"SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_DRAW}, o_orderkey) - 1 AS rk, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders"


def _split_orders(spark, d):
    return corpus.split(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", {"train": 0.6, "val": 0.2, "test": 0.2})


@query(f"SELECT o_orderkey, o_orderstatus, CASE WHEN rk < floor(n * 0.6 + 0.5) THEN 'train' WHEN rk < floor(n * 0.8 + 0.5) THEN 'val' ELSE 'test' END AS part FROM ({_RANK})")
def d04_stratified_split(spark, d):
    return _split_orders(spark, d).select("o_orderkey", "o_orderstatus", "part")


@query(f"SELECT o_orderkey, (rk % 5)::BIGINT AS fold FROM ({_RANK})")
def d05_folds(spark, d):
    return _split_orders(spark, d).select("o_orderkey", (F.col("rank") % 5).cast("long").alias("fold"))


@query(f"SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rk FROM ({LABELLED})) WHERE (label = 1 AND rk <= 20) OR (label = 0 AND rk <= 180)")
def d06_quota_sample(spark, d):
    return corpus.quota(labelled(spark, d), "label", "doc_id", 200).select("doc_id", "label")


@query("SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5('sample-1' || o_orderkey), 1, 8))::BIGINT < 429496729")
def d07_fraction_sample(spark, d):
    return table(spark, d, "orders").select("o_orderkey").where(corpus.hash_order("sample-1", F.col("o_orderkey")) < 429496729)


@query("SELECT o_orderkey FROM orders ORDER BY ('0x' || substr(md5('sample-2' || o_orderkey), 1, 8))::BIGINT, o_orderkey LIMIT 500")
def d07_fixed_sample(spark, d):
    """Five hundred orders, drawn."""
    return corpus.sample(table(spark, d, "orders").select("o_orderkey"), 500, "o_orderkey", "sample-2")


@query("SELECT doc_id, length(text)::BIGINT AS n FROM documents ORDER BY n DESC, doc_id")
def d08_length_order(spark, d):
    return docs(spark, d).select("doc_id", F.length("text").cast("long").alias("n")).orderBy(F.desc("n"), "doc_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rk FROM documents) WHERE rk <= 3")
def d09_examples_per_group(spark, d):
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.length("text").desc(), "doc_id"))
    return docs(spark, d).withColumn("rk", rank).where("rk <= 3").select("source", "doc_id")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def d10_head(spark, d):
    return docs(spark, d).select("doc_id", "source").orderBy("doc_id").limit(100)


# nested data

_VERDICT = "CASE doc_id % 3 WHEN 0 THEN '{\"is_toxic\":true,\"toxicity_score\":0.5}' WHEN 1 THEN '{\"toxicity_score\":0.25,\"is_spam\":true,\"spam_score\":0.75}' ELSE '{}' END"


@query(
    f"""SELECT doc_id, coalesce((v->>'$.is_toxic')::BOOLEAN, false) AS is_toxic, coalesce((v->>'$.toxicity_score')::DOUBLE, 0) AS toxicity_score,
    coalesce((v->>'$.is_spam')::BOOLEAN, false) AS is_spam, coalesce((v->>'$.spam_score')::DOUBLE, 0) AS spam_score FROM (SELECT doc_id, ({_VERDICT})::JSON AS v FROM documents)"""
)
def n01_parse_verdict(spark, d):
    v = F.from_json(F.expr(_VERDICT), "is_toxic boolean, toxicity_score double, is_spam boolean, spam_score double")
    fields = (("is_toxic", False), ("toxicity_score", 0.0), ("is_spam", False), ("spam_score", 0.0))
    return docs(spark, d).select("doc_id", v.alias("v")).select("doc_id", *[F.coalesce(f"v.{k}", F.lit(x)).alias(k) for k, x in fields])


@query(f"""SELECT doc_id, '{{"is_toxic":' || is_toxic || ',"types":"' || toxicity_types || '"}}' AS value, CASE WHEN tox_model_used = 'regex' THEN 300 ELSE 3600 END AS ttl_s FROM ({_V})""")
def n02_serialise_verdict(spark, d):
    v = verdicts(spark, d, docs(spark, d))
    return v.select("doc_id", F.to_json(F.struct("is_toxic", F.col("toxicity_types").alias("types"))).alias("value"), F.when(F.col("tox_model_used") == "regex", 300).otherwise(3600).alias("ttl_s"))


@query("""SELECT event_id, props->>'$.k' AS k, coalesce(try_cast(json_array_length(json_keys(props)) AS BIGINT), 0) AS n FROM events""")
def n03_maps(spark, d):
    m = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(m).cast("long").alias("n"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS pos, text FROM conversations")
def n04_explode_batches(spark, d):
    batch = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("items"))
    return batch.select("conv_id", F.posexplode("items").alias("pos", "item")).select("conv_id", F.col("pos").cast("long").alias("pos"), "item.text")


@query(
    """SELECT doc_id, array_to_string(CASE WHEN len(ids) >= 8 THEN list_concat(ids[1:7], [102]) ELSE list_concat(ids, list_transform(range(0, 8 - len(ids)), lambda x: 0)) END, ',') AS ids
    FROM (SELECT doc_id, list_concat([101], list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: length(w)), [102]) AS ids FROM documents)"""
)
def n05_pad_ids(spark, d):
    words = F.filter(F.split("text", " "), lambda w: w != "")
    ids = F.concat(F.array(F.lit(101)), F.transform(words, lambda w: F.length(w)), F.array(F.lit(102)))
    padded = F.when(F.size(ids) >= 8, F.concat(F.slice(ids, 1, 7), F.array(F.lit(102)))).otherwise(F.concat(ids, F.array_repeat(F.lit(0), F.greatest(F.lit(0), 8 - F.size(ids)))))
    return docs(spark, d).select("doc_id", F.array_join(padded.cast("array<string>"), ",").alias("ids"))
