"""How queries are registered, and the views of the given tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import rules, text
from ..functions.text import EDGE, TAIL

# A Latin rule set for the given tables, with stems that occur in their prose.
LATIN = {
    "thstem": EDGE + "thth[a-z]*",
    "ending": "(?:tiontion|bleble)" + TAIL,
    "ounou": "ouou|heheha?",
    "mail": r"[a-z0-9._-]@[a-z0-9-]+\.[a-z]",
    "symbols": r"(?:&&&|\*\*\*|###|%%%|\$\$\$)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "source")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files give fewer tasks than there are: for heavy work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text, label (toxic), quality: the documents that have labels."""
    labels = table(spark, d, "labels").selectExpr("doc_id", "toxic AS label", "quality")
    return docs(spark, d).join(labels, "doc_id")


# SQL twins

LABELLED = "SELECT d.doc_id, d.text, l.toxic AS label, l.quality FROM documents d JOIN labels l USING (doc_id)"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str = " ") -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(by)}, 'g')"


def sql_strip(x: str) -> str:
    return sub(x, rf"^[{text.WS}]+|[{text.WS}]+$", "")


def sql_collapse(x: str) -> str:
    return sql_strip(sub(x, text.SPACES))


def sql_normalise(x: str, punctuation: bool = True) -> str:
    out = f"lower(coalesce({x}, ''))"
    for pattern, by in ((text.URL_EMAIL, " "), (text.TAGS_LAZY, " "), (text.MENTION, ""), (text.ENTITIES_GREEDY, " ")):
        out = sub(out, pattern, by)
    return sql_collapse(sub(out, text.PUNCTUATION) if punctuation else out)


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {quote(f'[{text.WS}]+')}), lambda w: w <> '')"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(quote(w) for w in words) + "]"


def sql_drop(x: str, words: list[str]) -> str:
    return f"array_to_string(list_filter({sql_tokens(x)}, lambda w: NOT list_contains({sql_list(words)}, lower(w))), ' ')"


def sql_spam(x: str, words: list[str] = text.SPAM_STOP_WORDS) -> str:
    out = sub(sub(sub(f"coalesce({x}, '')", text.TAGS), text.MENTION_ID, ""), text.ENTITIES)
    return sql_drop(sql_collapse(out), words)


def sql_hit(x: str, pattern: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), {quote('(?i)' + pattern)})"


def sql_any(x: str, patterns: dict[str, str] = LATIN) -> str:
    return sql_hit(x, "|".join(f"(?:{p})" for p in patterns.values()))


def sql_mask(x: str, patterns: dict[str, str]) -> str:
    return "(" + " + ".join(f"CASE WHEN {sql_hit(x, p)} THEN {1 << k} ELSE 0 END" for k, p in enumerate(patterns.values())) + ")::BIGINT"


def sql_names(x: str, patterns: dict[str, str]) -> str:
    return "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {sql_hit(x, p)} THEN {quote(k)} END" for k, p in patterns.items()) + "], lambda c: c IS NOT NULL)), ',')"


def sql_prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    def r(a, b):
        return f"round(CASE WHEN {b} = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END, 6)"

    return f"{r(tp, f'({tp} + {fp})')} AS precision, {r(tp, f'({tp} + {fn})')} AS recall, {r(f'2 * {tp}', f'(2 * {tp} + {fp} + {fn})')} AS f1"


def sql_gram_counts(source: str, x: str, least: int = 3, most: int = 4) -> str:
    """doc_id, term, tf of the n-grams inside the words of x."""
    sizes = ", ".join(str(n) for n in range(least, most + 1))
    return f"""SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(CASE WHEN length(p) <= n THEN [p] ELSE list_transform(range(1, length(p) - n + 2), lambda i: substr(p, i, n)) END) AS term
      FROM (SELECT doc_id, p, unnest([{sizes}]) AS n FROM (SELECT doc_id, ' ' || unnest({sql_tokens(x)}) || ' ' AS p FROM {source})) WHERE n = {least} OR length(p) >= n) GROUP BY doc_id, term"""


def sql_bayes(name: str, x: str, labels: str) -> str:
    """CTEs of a complement naive Bayes model on x over labels (doc_id, text, label): <name>_model has term, idf, coef."""
    return f"""{name}_l AS (SELECT doc_id, label, made FROM (SELECT doc_id, label, {x} AS made FROM ({labels}) WHERE label IS NOT NULL) WHERE made <> ''),
    {name}_t AS ({sql_gram_counts(f"{name}_l", "made")}),
    {name}_v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM {name}_l)) / (1.0 + count(*))) + 1.0 AS idf FROM {name}_t GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 45000),
    {name}_w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM {name}_t JOIN {name}_v USING (term)),
    {name}_n AS (SELECT doc_id, term, label, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM {name}_w JOIN {name}_l USING (doc_id)),
    {name}_c AS (SELECT term, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS w1, sum(CASE WHEN label = 0 THEN w ELSE 0 END) AS w0 FROM {name}_n GROUP BY term),
    {name}_model AS (SELECT term, idf, ln((w1 + 1) / (sum(w1) OVER () + count(*) OVER ())) - ln((w0 + 1) / (sum(w0) OVER () + count(*) OVER ())) AS coef FROM {name}_c JOIN {name}_v USING (term))"""


def sql_bayes_scores(name: str, source: str, x: str) -> str:
    """doc_id, p of the documents that have words."""
    return f"""SELECT doc_id, 1 / (1 + exp(-coalesce(sum(w * coef) / sqrt(sum(w * w)), 0))) AS p
    FROM (SELECT doc_id, (1 + ln(tf)) * idf AS w, coef FROM ({sql_gram_counts(source, x)}) LEFT JOIN {name}_model USING (term)) GROUP BY doc_id"""


TOXIC_LABELS = "SELECT d.doc_id, d.text, l.toxic::INT AS label FROM documents d JOIN labels l USING (doc_id)"
SPAM_LABELS = "SELECT d.doc_id, d.text, (l.quality = 0)::INT AS label FROM documents d JOIN labels l USING (doc_id)"

_models: dict = {}


def spam_labelled(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text, label: bad quality stands for spam."""
    return labelled(spark, d).selectExpr("doc_id", "text", "CAST(quality = 0 AS INT) AS label")


def fitted(spark: SparkSession, d: str, mode: str = "both"):
    """The toxicity and the spam model of a folder's labels, each fitted once for a session; None where the mode has no use for it."""
    from ..operators import models

    def made(side: str):
        key = (spark.sparkContext.applicationId, d, side)
        if key not in _models:
            _models[key] = models.fit_bayes(labelled(spark, d)) if side == "tox" else models.fit_bayes(spam_labelled(spark, d), "spam")
        return _models[key]

    return made("tox") if mode != "spam_only" else None, made("spam") if mode != "tox_only" else None
