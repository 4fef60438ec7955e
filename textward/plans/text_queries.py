"""Queries of the text, feature, label and source operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions import text as tx
from ..operators import corpus
from ..sources import tables
from . import base
from .base import LABELLED, docs, labelled, query, quote, sub, table

# Frequent Latin words, stop words of the given tables.
LATIN_STOP = "the of and to in a is that for it on was be as de la le les et der die und el los en".split()


def _doc(column, source="documents"):
    """A query of one text Column over documents."""

    def run(spark, d):
        return base.spread(docs(spark, d)).select("doc_id", column(F.col("text")).alias("out"))

    return run


def _reg(name, column, sql):
    f = _doc(column)
    f.__name__ = name
    query(f"SELECT doc_id, {sql} AS out FROM documents")(f)


T = "coalesce(text, '')"
_reg("x01_lower", lambda t: F.lower(tx.clean(t)), f"lower({T})")
_reg("x02_strip_links", lambda t: tx.replace(tx.clean(t), tx.URL_EMAIL), sub(T, tx.URL_EMAIL))
_reg("x04_strip_mentions", lambda t: tx.replace(tx.replace(tx.clean(t), tx.MENTION, ""), tx.MENTION_ID, ""), sub(sub(T, tx.MENTION, ""), tx.MENTION_ID, ""))
_reg("x06_strip_punctuation", lambda t: tx.replace(tx.clean(t), tx.PUNCTUATION), sub(T, tx.PUNCTUATION))
_reg("x07_collapse_spaces", lambda t: tx.collapse(tx.clean(t)), base.sql_collapse(T))
_reg("x08_normalise", tx.normalise, base.sql_normalise("text"))
_reg("x09_stop_words", lambda t: tx.drop_words(tx.clean(t), LATIN_STOP), base.sql_drop(T, LATIN_STOP))
_reg("x11_process", lambda t: tx.process(t, LATIN_STOP), base.sql_drop(base.sql_normalise("text"), LATIN_STOP))
_reg("x12_process_spam", lambda t: tx.process_spam(t, LATIN_STOP), base.sql_spam("text", LATIN_STOP))
_reg("x15_cache_key", tx.cache_key, f"'moderation:cache:' || sha256(lower({base.sql_strip(T)}))")
_reg("x18_strip_emoji", lambda t: tx.replace(tx.clean(t), tx.EMOJI), sub(T, tx.EMOJI))


@query(f"SELECT page_id, {sub('html', tx.TAGS_LAZY)} AS lazy, {sub('html', tx.TAGS)} AS bounded FROM pages")
def x03_strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", tx.replace(F.col("html"), tx.TAGS_LAZY).alias("lazy"), tx.replace(F.col("html"), tx.TAGS).alias("bounded"))


@query(f"SELECT page_id, {sub('html', tx.ENTITIES_GREEDY)} AS greedy, {sub('html', tx.ENTITIES)} AS tight FROM pages")
def x05_strip_entities(spark, d):
    return table(spark, d, "pages").select("page_id", tx.replace(F.col("html"), tx.ENTITIES_GREEDY).alias("greedy"), tx.replace(F.col("html"), tx.ENTITIES).alias("tight"))


@query(
    f"""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest({base.sql_tokens("lower(text)")}) AS word FROM documents)),
    lemma AS (SELECT word, CASE WHEN length(word) > 5 AND ends_with(word, 'ing') THEN left(word, length(word) - 3) ELSE word END AS lemma FROM w),
    t AS (SELECT doc_id, row_number() OVER () AS r, {base.sql_tokens("lower(coalesce(text, ''))")} AS words FROM documents),
    e AS (SELECT doc_id, r, unnest(range(1, len(words) + 1)) AS i, words FROM t)
    SELECT e.doc_id, translate(string_agg(l.lemma, ' ' ORDER BY e.i), 'ёъ', 'еь') AS out FROM e JOIN lemma l ON l.word = e.words[e.i] GROUP BY e.doc_id, e.r"""
)
def x10_lemmatise(spark, d):
    rows = docs(spark, d)
    words = rows.select(F.explode(F.array_distinct(tx.tokens(F.lower("text")))).alias("word")).distinct()
    lemma = F.when((F.length("word") > 5) & F.col("word").endswith("ing"), F.expr("left(word, length(word) - 3)")).otherwise(F.col("word"))
    return corpus.lemmatise(rows, words.select("word", lemma.alias("lemma")))


def _sql_core(w):
    return sub(w, rf"^{tx.TOKEN_EDGE}+|{tx.TOKEN_EDGE}+$", "")


def _sql_caps(w):
    letters = sub(_sql_core(w), r"[^\p{L}]", "")
    return f"(length({letters}) >= 2 AND regexp_matches(substr({letters}, 2), '\\p{{Lu}}'))"


@query(f"SELECT doc_id, len(list_filter({base.sql_tokens(T)}, lambda w: {_sql_caps('w')}))::BIGINT AS out FROM documents")
def x13_caps_tokens(spark, d):
    return docs(spark, d).select("doc_id", F.size(F.filter(tx.tokens(tx.clean(F.col("text"))), tx.is_caps)).cast("long").alias("out"))


@query(
    f"""SELECT doc_id, array_to_string(list_filter({base.sql_tokens(T)}, lambda w: {_sql_caps('w')}), ' ') AS caps,
    array_to_string(list_transform(list_filter({base.sql_tokens(T)}, lambda w: NOT {_sql_caps('w')}), lambda w: lower(w)), ' ') AS rest FROM documents"""
)
def x14_split_caps(spark, d):
    caps, rest = tx.split_caps(F.col("text"))
    return docs(spark, d).select("doc_id", caps.alias("caps"), rest.alias("rest"))


# What the older recipe strips, in order.
OLD_RECIPE = [(r"@[A-Za-z0-9_]+", " "), (tx.URL_EMAIL, " "), (tx.TAGS, " "), (r"\[id\p{Nd}+\|[^\n]*\], ?", " "), (r"\p{Nd}{4,}|[0-9a-f]{8}-[0-9a-f-]{27}", " ")]
_reg(
    "x16_old_recipe",
    lambda t: tx.collapse(reduce(lambda x, s: tx.replace(x, *s), OLD_RECIPE, F.lower(tx.clean(t)))),
    base.sql_collapse(reduce(lambda x, s: sub(x, *s), OLD_RECIPE, f"lower({T})")),
)


@query(
    f"""WITH w AS (SELECT doc_id, ' ' || unnest({base.sql_tokens("lower(text)")}) || ' ' AS p FROM documents),
    g AS (SELECT doc_id, p, unnest([3, 4]) AS n FROM w),
    k AS (SELECT doc_id, CASE WHEN length(p) <= n THEN [p] ELSE list_transform(range(1, length(p) - n + 2), lambda i: substr(p, i, n)) END AS grams
          FROM g WHERE n = 3 OR length(p) >= n)
    SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(grams) AS gram FROM k) GROUP BY gram"""
)
def x17_char_ngrams(spark, d):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grams = tx.gram_counts(docs(spark, d).select("doc_id", "text").repartition(n, "doc_id"), ["doc_id"], F.lower(tx.clean(F.col("text"))), 3, 4)
    return grams.groupBy(F.col("term").alias("gram")).agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("n_docs"))


# features

S = base.sql_strip(T)


def _n(pattern, x="s"):
    return f"len(regexp_extract_all({x}, {quote(pattern)}))"


def _sql_share(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"


_LT = f"list_filter(list_transform({base.sql_tokens('s')}, lambda w: {_sql_core('w')}), lambda w: regexp_matches(w, '\\p{{L}}'))"
_UP = f"len(list_filter({_LT}, lambda w: NOT regexp_matches({sub('w', '[^' + chr(92) + 'p{L}]', '')}, '[^' || '\\p{{Lu}}]')))"
_URLS = f"regexp_extract_all(s, {quote(ft.URL)})"
_LONG = lambda p: f"ln(1 + coalesce(list_max(list_transform(regexp_extract_all(s, {quote(p)}), lambda r: length(r))), 0))"
_FEATURE_SQL = {
    "caps_ratio": _sql_share(_n(r"\p{Lu}"), _n(r"\p{L}")),
    "url_count": f"len({_URLS})::DOUBLE",
    "max_url_length_log1p": f"ln(1 + coalesce(list_max(list_transform({_URLS}, lambda u: length(u))), 0))",
    "has_short_domain": f"CASE WHEN regexp_matches(array_to_string({_URLS}, ' '), {quote(ft.SHORT)}) THEN 1.0 ELSE 0.0 END",
    "has_suspicious_tld": f"CASE WHEN regexp_matches(array_to_string({_URLS}, ' '), {quote(ft.ENDINGS)}) THEN 1.0 ELSE 0.0 END",
    "has_suspicious_params": f"CASE WHEN regexp_matches(s, {quote(ft.PARAMETERS)}) THEN 1.0 ELSE 0.0 END",
    "length_chars_log1p": "ln(1 + length(s))",
    "typo_score": _sql_share(f"len(list_filter({base.sql_tokens('s')}, lambda w: regexp_matches(w, {quote(ft.DIGIT_INSIDE + '|' + ft.DOTS_INSIDE)})))", f"len({base.sql_tokens('s')})"),
    "max_excl_run_log1p": _LONG("!+"),
    "max_q_run_log1p": _LONG(r"\?+"),
    "upper_words_count": f"{_UP}::DOUBLE",
    "upper_words_ratio": _sql_share(_UP, f"len({_LT})"),
    "space_ratio": _sql_share("length(s) - length(replace(s, ' ', ''))", "length(s)"),
    "single_letter_token_ratio": _sql_share(f"len(list_filter({_LT}, lambda w: length(w) = 1))", f"len({_LT})"),
    "weird_char_ratio": _sql_share(_n(ft.WEIRD), "length(s)"),
}
#: Features whose natural input is a URL are computed over pages.
_OVER_PAGES = ("url_count", "max_url_length_log1p", "has_short_domain", "has_suspicious_tld", "has_suspicious_params")


def _feature_query(name, number):
    over_pages = name in _OVER_PAGES
    key, column, source = ("page_id", "url", "pages") if over_pages else ("doc_id", "text", "documents")

    def run(spark, d):
        return base.spread(table(spark, d, source).select(key, column)).select(key, F.round(ft.feature(name, F.col(column)), 6).alias(name))

    run.__name__ = f"f{number:02d}_{name}"
    sql = _FEATURE_SQL.get(name)
    strip = base.sql_strip(f"coalesce({column}, '')")
    query(sql and f"SELECT {key}, round({sql}, 6) AS {name} FROM (SELECT {key}, {strip} AS s FROM {source})")(run)


_NUMBERS = dict(zip(ft.NAMES, (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, 11, 11, 12, 13, 14, 15)))
for _name in ft.NAMES:
    if _name != "repeated_chars_ratio":
        _feature_query(_name, _NUMBERS[_name])


@query(
    f"""WITH s AS (SELECT doc_id, row_number() OVER () AS r, {S} AS s FROM documents),
    c AS (SELECT r, unnest(range(1, length(s) + 1)) AS i, s FROM s),
    g AS (SELECT r, substr(s, i, 1) AS ch, i FROM c),
    k AS (SELECT r, ch, i, i - row_number() OVER (PARTITION BY r, ch ORDER BY i) AS isl FROM g),
    n AS (SELECT r, sum(CASE WHEN n >= 3 THEN n ELSE 0 END) AS rep FROM (SELECT r, ch, isl, count(*) AS n FROM k GROUP BY r, ch, isl) GROUP BY r)
    SELECT doc_id, round(CASE WHEN length(s) = 0 THEN 0 ELSE coalesce(rep, 0)::DOUBLE / length(s) END, 6) AS repeated_chars_ratio FROM s LEFT JOIN n USING (r)"""
)
def f07_repeated_chars_ratio(spark, d):
    return base.spread(docs(spark, d)).select("doc_id", F.round(ft.feature("repeated_chars_ratio", F.col("text")), 6).alias("repeated_chars_ratio"))


@query(f"SELECT doc_id, regexp_matches({T}, {quote(ft.CAPS_SHOUT)}) AS shout FROM documents")
def f16_caps_shout_rule(spark, d):
    return docs(spark, d).select("doc_id", ft.matches_caps_shout(F.col("text")).alias("shout"))


@query(f"SELECT doc_id, regexp_matches({T}, {quote(ft.CAPS_WORD)}) AS caps FROM documents")
def f17_caps_word_rule(spark, d):
    return docs(spark, d).select("doc_id", ft.matches_caps_word(F.col("text")).alias("caps"))


def _set_sql(names):
    return "SELECT doc_id, " + ", ".join(f"round({_FEATURE_SQL[n]}, 6) AS {n}" for n in names) + f" FROM (SELECT doc_id, {S} AS s FROM documents)"


@query(_set_sql(["caps_ratio", "space_ratio"]))
def f18_feature_set(spark, d):
    """Named features come in the fixed order, whatever the order of the names."""
    return docs(spark, d).select("doc_id", *[F.round(c, 6).alias(n) for c, n in zip(ft.features(F.col("text"), ["space_ratio", "caps_ratio"]), ["caps_ratio", "space_ratio"])])


@query(_set_sql(["length_chars_log1p", "space_ratio"]))
def f18_minimal_set(spark, d):
    return docs(spark, d).select("doc_id", *[F.round(c, 6).alias(n) for c, n in zip(ft.features(F.col("text"), ft.MINIMAL), ft.MINIMAL)])


@query()
def f18_full_set(spark, d):
    return base.spread(docs(spark, d)).select("doc_id", *ft.features(F.col("text")))


# labels and sources


@query(f"SELECT doc_id, {T} AS text FROM documents WHERE length({base.sql_normalise('text')}) > 0")
def p02_drop_blank(spark, d):
    return docs(spark, d).select("doc_id", tx.clean(F.col("text")).alias("text")).where(F.length(tx.normalise(F.col("text"))) > 0)


_LABELS = "CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN ' Spam' WHEN 2 THEN 'ham' WHEN 3 THEN '0.5' WHEN 4 THEN 'other' WHEN 5 THEN 'no' WHEN 6 THEN '' ELSE cast(toxic AS VARCHAR) END"


def _label_text(spark, d):
    return table(spark, d, "labels").select("doc_id", F.expr(_LABELS.replace("VARCHAR", "STRING")).alias("v"))


@query(
    f"""SELECT doc_id, CASE WHEN v IS NULL OR trim(v) = '' THEN 0 WHEN try_cast(trim(v) AS DOUBLE) IS NOT NULL THEN (try_cast(trim(v) AS DOUBLE) <> 0)::INT
    WHEN lower(trim(v)) IN ('spam','junk','toxic','1','true','yes','y') THEN 1 WHEN lower(trim(v)) IN ('ham','not_spam','0','false','no','n') THEN 0 ELSE 1 END AS label
    FROM (SELECT doc_id, {_LABELS} AS v FROM labels)"""
)
def p03_label_01(spark, d):
    return _label_text(spark, d).select("doc_id", corpus.label_01(F.col("v")).alias("label"))


@query(
    f"""SELECT doc_id, coalesce((CASE WHEN try_cast(trim(v) AS DOUBLE) IS NOT NULL THEN trunc(try_cast(trim(v) AS DOUBLE)) <> 0
    WHEN lower(trim(v)) IN ('spam','junk','toxic','1','true','yes','y') THEN true WHEN lower(trim(v)) IN ('ham','not_spam','0','false','no','n') THEN false END)::VARCHAR, 'unknown') AS label
    FROM (SELECT doc_id, {_LABELS} AS v FROM labels)"""
)
def p04_label_bool(spark, d):
    return _label_text(spark, d).select("doc_id", F.coalesce(corpus.label_bool(F.col("v")).cast("string"), F.lit("unknown")).alias("label"))


@query(
    f"""WITH a AS (SELECT doc_id, lower({base.sql_strip("coalesce(text, '')")}) AS text, (label <> 0)::INT AS label FROM ({LABELLED}))
    SELECT arg_min(doc_id, doc_id) AS doc_id, text, arg_min(label, doc_id) AS label FROM a WHERE text <> '' GROUP BY text"""
)
def p05_adapt_corpus(spark, d):
    return corpus.adapt(labelled(spark, d), "text", "label", "doc_id")


_RULE = f"(regexp_matches({T}, {quote(ft.CAPS_WORD)}) OR regexp_matches({T}, {quote(ft.CAPS_SHOUT)}))"


@query(f"SELECT doc_id, CASE WHEN {_RULE} THEN 1 ELSE (label <> 0)::INT END AS label FROM ({LABELLED})")
def p06_repair_labels(spark, d):
    return corpus.repair_labels(labelled(spark, d)).select("doc_id", "label")


@query(f"SELECT doc_id, CASE WHEN coalesce(label, 0) = 0 OR {base.sql_any('text')} THEN 1 ELSE 0 END AS label FROM ({LABELLED})")
def p07_invert_labels(spark, d):
    return corpus.invert_labels(labelled(spark, d), base.LATIN).select("doc_id", "label")


@query(f"SELECT doc_id, label FROM ({LABELLED}) WHERE NOT {_RULE}")
def p08_exclude_ruled(spark, d):
    return labelled(spark, d).where(~(ft.matches_caps_word(F.col("text")) | ft.matches_caps_shout(F.col("text")))).select("doc_id", "label")


@query(
    f"""SELECT doc_id, {base.sql_drop(base.sql_normalise('text'), LATIN_STOP)} AS classical, {base.sql_normalise('text')} AS neural, {base.sql_spam('text', LATIN_STOP)} AS spam, (label <> 0)::INT AS label
    FROM ({LABELLED}) WHERE {base.sql_drop(base.sql_normalise('text'), LATIN_STOP)} <> ''"""
)
def p15_prepare_training(spark, d):
    t = F.col("text")
    out = labelled(spark, d).select("doc_id", tx.process(t, LATIN_STOP).alias("classical"), tx.normalise(t).alias("neural"), tx.process_spam(t, LATIN_STOP).alias("spam"), corpus.label_01(F.col("label")).alias("label"))
    return out.where("classical <> ''")


@query("SELECT text, label::INT AS label FROM (SELECT d.text, l.toxic AS label FROM documents d JOIN labels l USING (doc_id)) WHERE text <> ''")
def s02_read_projected(spark, d):
    """A corpus of toxic and of other documents, one kept as CSV and one as Parquet, read by suffix."""
    rows, path = labelled(spark, d).where("text <> ''"), tables.scratch(spark, "corpus")
    tables.write_report(rows.where("label = 1").selectExpr("doc_id", "CAST(label AS INT) AS label", "text"), f"{path}/toxic.csv")
    rows.where("label <> 1").write.parquet(f"{path}/other.parquet")
    parts = [tables.read_labelled(spark, f"{path}/{name}").select("text", F.col("label").cast("int").alias("label")) for name in ("toxic.csv", "other.parquet")]
    return parts[0].unionByName(parts[1])


@query("SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark UNION ALL SELECT conv_id, text FROM conversations")
def s03_concatenate(spark, d):
    parts = [("documents", "doc_id"), ("benchmark", "item_id"), ("conversations", "conv_id")]
    return reduce(lambda a, b: a.unionByName(b), [table(spark, d, t).select(F.col(k).alias("id"), "text") for t, k in parts])


