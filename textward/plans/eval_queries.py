"""Queries of evaluation metrics, curves, correlations, n-gram statistics and rule mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions import rules
from ..functions import text as tx
from ..operators import metrics, mining
from . import base
from .base import LABELLED, labelled, query, quote, table
from .data_queries import _RANK, _V, _split_orders, verdicts
from .text_queries import _FEATURE_SQL, S

L = base.LATIN
_PRED = f"SELECT doc_id, label, {base.sql_any('text')} AS p FROM ({LABELLED})"
_CONF = "count(*) FILTER (p AND label = 1) AS tp, count(*) FILTER (p AND label <> 1) AS fp, count(*) FILTER (NOT p AND label = 1) AS fn, count(*) FILTER (NOT p AND label <> 1) AS tn"


def _predicted(spark, d):
    return labelled(spark, d).select("doc_id", "label", rules.any_hit(F.col("text"), L).alias("p"))


@query("SELECT toxic AS label, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY toxic")
def a01_class_shares(spark, d):
    counts = table(spark, d, "labels").groupBy(F.col("toxic").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    return counts.join(total).select("label", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query(f"SELECT tp, fp, fn, tn, {base.sql_prf()} FROM (SELECT {_CONF} FROM ({_PRED}))")
def a02_confusion(spark, d):
    return metrics.with_prf(_predicted(spark, d).agg(*metrics.confusion(F.col("p"), F.col("label"))))


_RULES = " UNION ALL ".join(f"SELECT {quote(k)} AS rule, label, {base.sql_hit('text', p)} AS p FROM ({LABELLED})" for k, p in L.items())


@query(f"SELECT rule, tp, fp, fn, tn, round((tp + fp) * 100.0 / (tp + fp + fn + tn), 6) AS triggered_pct, {base.sql_prf()} FROM (SELECT rule, {_CONF} FROM ({_RULES}) GROUP BY rule)")
def a03_rule_report(spark, d):
    stacked = F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), rules.hits(F.col("text"), p).alias("p")) for k, p in L.items()]))
    out = labelled(spark, d).select("label", stacked).groupBy("rule").agg(*metrics.confusion(F.col("p"), F.col("label")))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return metrics.with_prf(out.withColumn("triggered_pct", F.round((F.col("tp") + F.col("fp")) * 100.0 / total, 6)))


@query(f"SELECT doc_id, label, CASE WHEN label = 1 THEN 'FN' ELSE 'FP' END AS kind, {base.sql_names('text', L)} AS categories FROM ({LABELLED}) WHERE {base.sql_any('text')} <> (label = 1)")
def a04_error_table(spark, d):
    hit = rules.any_hit(F.col("text"), L)
    kind = F.when(F.col("label") == 1, "FN").otherwise("FP")
    return labelled(spark, d).where(hit != (F.col("label") == 1)).select("doc_id", "label", kind.alias("kind"), rules.names(rules.categories(F.col("text"), L)).alias("categories"))


# scores: line items with a label, so that curves have many distinct scores
_SCORED = "SELECT l_extendedprice::DOUBLE AS score, CASE WHEN l_returnflag = 'R' OR l_quantity > 40 THEN 1 ELSE 0 END AS label FROM lineitem"
_POINTS = f"""SELECT threshold, pos, neg, tp, fp, all_pos, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / all_pos AS recall FROM (
    SELECT score AS threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS all_pos
    FROM (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM ({_SCORED}) GROUP BY score) WINDOW w AS (ORDER BY score DESC))"""


def _points(spark, d):
    scored = table(spark, d, "lineitem").select(
        F.col("l_extendedprice").cast("double").alias("score"), F.when((F.col("l_returnflag") == "R") | (F.col("l_quantity") > 40), 1).otherwise(0).alias("label")
    )
    return metrics.curve(scored)


@query(f"SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM ({_POINTS})")
def a05_pr_curve(spark, d):
    return _points(spark, d).select("threshold", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"SELECT coalesce(arg_max(threshold, (precision >= 0.5, recall, -threshold)), 0.5) AS threshold FROM ({_POINTS})")
def a06_threshold_recall(spark, d):
    return metrics.best_threshold(_points(spark, d), 0.5)


@query(f"SELECT coalesce(arg_max(threshold, (precision >= 0.4, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 12), -threshold)), 0.5) AS threshold FROM ({_POINTS})")
def a07_threshold_f1(spark, d):
    return metrics.best_threshold(_points(spark, d), 0.4, "f1")


@query(f"SELECT round(sum(pos::DOUBLE / all_pos * precision), 6) AS ap FROM ({_POINTS})")
def a08_average_precision(spark, d):
    return metrics.average_precision(_points(spark, d)).select(F.round("ap", 6).alias("ap"))


@query(f"SELECT round(sum(neg * (tp - pos / 2.0))::DOUBLE / (max(all_pos) * sum(neg))::DOUBLE, 6) AS auc FROM ({_POINTS})")
def a09_roc_auc(spark, d):
    return metrics.roc_auc(_points(spark, d)).select(F.round("auc", 6).alias("auc"))


@query(
    f"""SELECT threshold, tp, fp, fn, tn, {base.sql_prf()} FROM (SELECT threshold, {_CONF} FROM
    (SELECT t.threshold, s.label, s.score >= t.threshold AS p FROM ({_SCORED}) s, (VALUES (20000.0::DOUBLE), (50000.0::DOUBLE)) t(threshold)) GROUP BY threshold)"""
)
def a10_fixed_thresholds(spark, d):
    scored = table(spark, d, "lineitem").select(
        F.col("l_extendedprice").cast("double").alias("score"),
        F.when((F.col("l_returnflag") == "R") | (F.col("l_quantity") > 40), 1).otherwise(0).alias("label"),
        F.explode(F.array(F.lit(20000.0), F.lit(50000.0))).alias("threshold"),
    )
    return metrics.with_prf(scored.groupBy("threshold").agg(*metrics.confusion(F.col("score") >= F.col("threshold"), F.col("label"))))


_USED = [n for n in ft.NAMES if n not in ("repeated_chars_ratio", "has_phone")]  # those that the other engine can spell
_FEATS = "SELECT label, " + ", ".join(f"{_FEATURE_SQL[k]} AS {k}" for k in _USED) + f" FROM (SELECT label, {S} AS s FROM ({LABELLED}))"


def _features(spark, d, names):
    return base.spread(labelled(spark, d).select("label", "text")).select("label", *ft.features(F.col("text"), names))


@query(f"WITH f AS ({_FEATS}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM f HAVING abs(corr({a}, {b})) >= 0.3 AND NOT isnan(corr({a}, {b}))" for k, a in enumerate(_USED) for b in _USED[k + 1 :]))
def a11_correlations(spark, d):
    """Pairs of hand-made features with a correlation of 0.3 or more, either way."""
    found = metrics.correlations(_features(spark, d, _USED), _USED)
    return found.where(F.abs("r") >= 0.3).withColumn("r", F.round("r", 4))


@query()
def a11_matrix(spark, d):
    """All 17 features against each other; null where one is constant."""
    return metrics.correlations(_features(spark, d, ft.NAMES), ft.NAMES)


_AUC = """(SELECT round(greatest(a, 1 - a), 4) FROM (SELECT sum(neg * (pos_above + pos / 2.0)) / (sum(pos) * sum(neg)) AS a FROM
    (SELECT *, coalesce(sum(pos) OVER (ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_above FROM (SELECT {k} AS v, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM f GROUP BY {k}))))"""


@query(
    f"WITH f AS ({_FEATS}) " + " UNION ALL ".join(
        f"SELECT '{k}' AS feature, CASE WHEN isnan(corr({k}, label)) THEN NULL ELSE round(corr({k}, label), 4) END AS r, round(avg({k}) FILTER (label = 1), 6) AS mean_1, round(avg({k}) FILTER (label = 0), 6) AS mean_0, "
        f"round(avg({k}) FILTER (label = 1) - avg({k}) FILTER (label = 0), 6) AS delta, {_AUC.format(k=k)} AS auc FROM f" for k in ft.MINIMAL + ["caps_ratio", "weird_char_ratio"]
    )
)
def a12_feature_target(spark, d):
    names = [n for n in ft.NAMES if n in [*ft.MINIMAL, "caps_ratio", "weird_char_ratio"]]
    out = metrics.feature_table(_features(spark, d, names), names)
    return out.select("feature", F.round("r", 4).alias("r"), *[F.round(c, 6).alias(c) for c in ("mean_1", "mean_0", "delta")], F.round("auc", 4).alias("auc"))


@query()
def a12_model_table(spark, d):
    """The table of all features with p-values and the spam model's coefficients."""
    from ..operators import models

    model = models.fit(base.spam_labelled(spark, d), "spam")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = models._kept(ft.with_features(base.spam_labelled(spark, d).repartition(n, "doc_id"), "text", ft.NAMES, ["label"]), "features")  # they are read several times
    coefficients = spark.createDataFrame([(name, float(c)) for name, _, _, c in model.extra], "feature string, coefficient double")  # 17 rows
    found = metrics.feature_table(rows, ft.NAMES).join(F.broadcast(coefficients), "feature", "left")
    kept = found.collect()  # a row per feature
    return spark.createDataFrame([(*r, metrics.correlation_p(r["r"], r["n"])) for r in kept], found.schema.add("p_value", "double"))


@query()
def a12_p_values(spark, d):
    """The correlations with their p-values; a row per feature passes through the driver."""
    found = metrics.feature_table(_features(spark, d, ft.MINIMAL), ft.MINIMAL).select("feature", "r", "n").collect()
    return spark.createDataFrame([(x["feature"], x["r"], metrics.correlation_p(x["r"], x["n"])) for x in found], "feature string, r double, p_value double")


@query("SELECT doc_id, d.text IS NOT NULL AS has_text, l.toxic = 1 AS label FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL")
def a26_labelled_rows(spark, d):
    return labelled(spark, d).where("label IS NOT NULL").select("doc_id", F.col("text").isNotNull().alias("has_text"), (F.col("label") == 1).alias("label"))


@query(
    f"""WITH t AS (SELECT DISTINCT doc_id, label, unnest({base.sql_tokens("lower(coalesce(text, ''))")}) AS term FROM ({LABELLED})),
    n AS (SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM ({LABELLED})),
    c AS (SELECT term, count(*) FILTER (label = 1) AS d1, count(*) FILTER (label = 0) AS d0 FROM t GROUP BY term)
    SELECT term, d1, d0, round(d1::DOUBLE / n1, 6) AS rate_1, round(d0::DOUBLE / n0, 6) AS rate_0, CASE WHEN d0 = 0 THEN 1e308 ELSE round((d1::DOUBLE / n1) / (d0::DOUBLE / n0), 6) END AS lift FROM c, n"""
)
def a13_term_lift(spark, d):
    """Share of documents of either class that have a term, and their ratio; without any of class 0 it is the largest number."""
    rows = labelled(spark, d)
    own = rows.groupBy("doc_id", "label").agg(F.array_join(F.collect_list("text"), " ").alias("text"))  # rows of one id and label are one document
    terms = own.select("label", F.explode(F.array_distinct(tx.tokens(tx.lower(F.col("text"))))).alias("term"))
    return metrics.term_lift(terms, rows)


@query("SELECT toxic AS label, count(*) AS n, round((SELECT count(*) FROM labels)::DOUBLE / ((SELECT count(DISTINCT toxic) FROM labels) * count(*)), 6) AS weight FROM labels GROUP BY toxic")
def a15_class_weights(spark, d):
    return metrics.class_weights(table(spark, d, "labels").select(F.col("toxic").alias("label"))).withColumn("weight", F.round("weight", 6))


@query("SELECT round(CASE WHEN count(*) = 0 OR avg(toxic) IN (0, 1) THEN 0.5 ELSE least(0.95, greatest(0.05, 1 - avg(toxic))) END, 6) AS alpha FROM labels")
def a16_auto_alpha(spark, d):
    m = F.avg("toxic")
    return table(spark, d, "labels").agg(F.round(F.when((F.count(F.lit(1)) == 0) | m.isin(0.0, 1.0), 0.5).otherwise(F.least(F.lit(0.95), F.greatest(F.lit(0.05), 1 - m))), 6).alias("alpha"))


@query(
    """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, (label % 2)::DOUBLE AS y FROM embeddings),
    l AS (SELECT *, y * (least(x, 0) - ln(1 + exp(-abs(x)))) + (1 - y) * (least(-x, 0) - ln(1 + exp(-abs(x)))) AS lp FROM e)
    SELECT vec_id, round(-(0.25 * y + 0.75 * (1 - y)) * pow(1 - exp(lp), 2) * lp, 6) AS focal, round(-lp, 6) AS bce FROM l"""
)
def a17_losses(spark, d):
    x, y = F.col("embedding")[0].cast("double"), F.col("label") % 2
    bce = metrics.focal_loss(x, y, 0.5, 0.0) * 2
    return table(spark, d, "embeddings").select("vec_id", F.round(metrics.focal_loss(x, y), 6).alias("focal"), F.round(bce, 6).alias("bce"))


_SWEEP = [(2, 3, 1000), (2, 3, 100_000), (3, 4, 5000), (3, 4, 100_000)]


@query(
    f"WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS made FROM documents), g AS MATERIALIZED ({base.sql_gram_counts('d', 'made', 2, 4)}), h AS MATERIALIZED ({base.sql_gram_counts('d', 'made', 3, 4)}) "
    + " UNION ALL ".join(
        f"SELECT {a} AS least, {b} AS most, {m} AS max_features, count(*) AS vocabulary, round(sum(df)::DOUBLE / (SELECT count(*) FROM documents), 4) AS nonzeros_per_doc FROM "
        f"(SELECT term, count(*) AS df FROM {'g' if a == 2 else 'h'} WHERE length(term) <= {b} GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {m})" for a, b, m in _SWEEP
    )
)
def a18_ngram_sweep(spark, d):
    """Vocabulary and nonzeros per document for ranges of n-gram sizes and bounds of the vocabulary."""
    return metrics.ngram_sweep(base.docs(spark, d).select("doc_id", F.lower(tx.clean(F.col("text"))).alias("made")), _SWEEP)


_STORED = f"SELECT v.*, l.toxic, l.quality FROM ({_V}) v LEFT JOIN labels l USING (doc_id)"


@query(
    f"""SELECT side, tp, fp, fn, tn, {base.sql_prf()} FROM (SELECT side, {_CONF} FROM (
    SELECT 'spam' AS side, is_spam AS p, CASE WHEN quality IS NOT NULL THEN (quality = 0)::INT END AS label FROM ({_STORED}) UNION ALL SELECT 'toxicity', is_toxic, toxic FROM ({_STORED})) WHERE label IS NOT NULL GROUP BY side)"""
)
def a26_labelled_evaluation(spark, d):
    """Stored verdicts of both sides against the labels that exist; rows without one are left out."""
    stored = verdicts(spark, d, base.docs(spark, d).select("doc_id", "text")).select("doc_id", "is_toxic", "is_spam")
    labels = table(spark, d, "labels").selectExpr("doc_id", "toxic", "CAST(quality = 0 AS INT) AS spam")
    return metrics.evaluate(stored.join(labels, "doc_id", "left"), {"toxicity": ("is_toxic", "toxic"), "spam": ("is_spam", "spam")})


@query(
    f"""WITH r AS (SELECT (rk % 5)::BIGINT AS fold, l.l_extendedprice::DOUBLE AS s, l.l_quantity AS q FROM ({_RANK}) o JOIN lineitem l ON l.l_orderkey = o.o_orderkey),
    f AS (SELECT fold, round(avg(s), 6) AS score, max(q)::DOUBLE AS threshold FROM r GROUP BY fold)
    SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS least, max(score) AS most, arg_max(fold, score) AS best, arg_max(threshold, score) AS threshold FROM f"""
)
def a34_fold_summary(spark, d):
    """Folds of orders by D5; of each fold a score and a threshold from its line items; mean, spread, and the best fold's threshold."""
    folds = _split_orders(spark, d).select("o_orderkey", (F.col("rank") % 5).cast("long").alias("fold"))
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").cast("double").alias("s"), F.col("l_quantity").cast("double").alias("q"))
    per_fold = items.join(folds, "o_orderkey").groupBy("fold").agg(F.round(F.avg("s"), 6).alias("score"), F.max("q").alias("threshold"))
    return metrics.fold_summary(per_fold)


# rule mining

_MASKED = f"SELECT {base.sql_mask('text', L)} AS mask, label FROM ({LABELLED})"
_HIST = f"SELECT mask, label, count(*) AS n FROM ({_MASKED}) GROUP BY mask, label"
_BITS = ", ".join(f"({quote(k)}, {1 << i})" for i, k in enumerate(L))


def _hist(spark, d):
    return mining.histogram(base.spread(labelled(spark, d).select("text", "label")), L)


@query(f"SELECT doc_id, {base.sql_mask('text', L)} AS mask FROM documents")
def r01_masks(spark, d):
    return base.docs(spark, d).select("doc_id", rules.mask(F.col("text"), L).alias("mask"))


@query(_HIST)
def r02_histogram(spark, d):
    return _hist(spark, d)


# the cost of a pattern: its length, a stand-in for measured times that both engines can compute
_COSTS = {k: float(len(p)) for k, p in L.items()}
_SHARES = "CASE pattern " + " ".join(f"WHEN {quote(k)} THEN {c / sum(_COSTS.values())!r}" for k, c in _COSTS.items()) + " END"


@query(
    f"""SELECT pattern, hits, tp, fp, unique_tp, round(p, 6) AS precision, round(r, 6) AS unique_recall,
    CASE WHEN hits = 0 THEN 'drop: no hits' WHEN p < 0.3 AND unique_tp = 0 THEN 'drop: imprecise' WHEN p < 0.3 THEN 'rewrite' WHEN unique_tp = 0 AND fp > 0 THEN 'drop: double' WHEN unique_tp = 0 AND tp > 0 THEN 'double'
      WHEN {_SHARES} > 0.25 AND r < 0.01 THEN 'dear' WHEN r >= 0.005 THEN 'keep' ELSE 'open' END AS advice
    FROM (SELECT *, CASE WHEN hits = 0 THEN 1.0 ELSE tp::DOUBLE / hits END AS p, CASE WHEN positives = 0 THEN 0.0 ELSE unique_tp::DOUBLE / positives END AS r FROM (
      SELECT pattern, count(*) FILTER (mask & bit <> 0) AS hits, count(*) FILTER (mask & bit <> 0 AND label = 1) AS tp, count(*) FILTER (mask & bit <> 0 AND label <> 1) AS fp,
      count(*) FILTER (mask = bit AND label = 1) AS unique_tp, count(*) FILTER (label = 1) AS positives FROM ({_MASKED}), (VALUES {_BITS}) b(pattern, bit) GROUP BY pattern))"""
)
def r03_pattern_stats(spark, d):
    return mining.per_pattern(_hist(spark, d), L, 0.3, _COSTS)


@query(f"SELECT tp, fp, fn, tn, {base.sql_prf()} FROM (SELECT {_CONF} FROM (SELECT mask <> 0 AS p, label FROM ({_MASKED})))")
def r04_union_metrics(spark, d):
    p, y = F.col("mask") != 0, F.col("label") == 1
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return metrics.with_prf(_hist(spark, d).agg(n(p & y).alias("tp"), n(p & ~y).alias("fp"), n(~p & y).alias("fn"), n(~p & ~y).alias("tn")))


def _impact(condition):
    return f"""SELECT pattern, tp_lost, fp_saved, round(CASE WHEN positives = 0 THEN 0 ELSE tp_lost::DOUBLE / positives END, 6) AS recall_lost FROM (
    SELECT pattern, count(*) FILTER ({condition} AND label = 1) AS tp_lost, count(*) FILTER ({condition} AND label <> 1) AS fp_saved, count(*) FILTER (label = 1) AS positives
    FROM ({_MASKED}), (VALUES {_BITS}) b(pattern, bit) GROUP BY pattern)"""


@query(_impact("mask = bit"))
def r05_removal_exclusive(spark, d):
    return mining.removal_impact(_hist(spark, d), L)


@query(_impact("mask & bit <> 0"))
def r05_removal_drop_hits(spark, d):
    return mining.removal_impact(_hist(spark, d), L, "drop_hits")


_COST = " + ".join(f"CASE WHEN subset & {1 << i} <> 0 THEN {c} ELSE 0.0 END" for i, c in enumerate(_COSTS.values()))
_SUBSETS = f"""SELECT subset, tp, fp, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision, round(CASE WHEN positives = 0 THEN 0 ELSE tp::DOUBLE / positives END, 6) AS recall,
    round(CASE WHEN tp + fp + positives = 0 THEN 0 ELSE 2.0 * tp / (tp + fp + positives) END, 6) AS f1, ({_COST})::DOUBLE AS cost
    FROM (SELECT subset, count(*) FILTER (mask & subset <> 0 AND label = 1) AS tp, count(*) FILTER (mask & subset <> 0 AND label <> 1) AS fp, count(*) FILTER (label = 1) AS positives
    FROM ({_MASKED}), range(1, {1 << len(L)}) s(subset) GROUP BY subset)"""


@query(f"SELECT * FROM ({_SUBSETS}) WHERE precision >= 0.1")
def r06_subsets(spark, d):
    return mining.subsets(_hist(spark, d), L, 0.1, _COSTS)


@query(
    f"""WITH a AS (SELECT * FROM ({_SUBSETS}) WHERE precision >= 0.1) SELECT * FROM a WHERE NOT EXISTS
    (SELECT 1 FROM a b WHERE b.recall >= a.recall AND b.cost <= a.cost AND (b.recall > a.recall OR b.cost < a.cost))"""
)
def j10_pareto(spark, d):
    return mining.pareto(mining.subsets(_hist(spark, d), L, 0.1, _COSTS))


@query()
def r07_greedy(spark, d):
    return mining.greedy(_hist(spark, d), L, 0.1, _COSTS)


_WORST = f"""SELECT pattern FROM (SELECT pattern, count(*) FILTER (mask & bit <> 0) AS hits, count(*) FILTER (mask & bit <> 0 AND label <> 1) AS fp, count(*) FILTER (mask & bit <> 0 AND label = 1) AS tp
    FROM ({_MASKED}), (VALUES {_BITS}) b(pattern, bit) GROUP BY pattern) WHERE fp > 0 ORDER BY tp::DOUBLE / hits, pattern LIMIT 3"""


@query(
    "SELECT pattern, doc_id, example FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY doc_id) AS rk FROM ("
    + " UNION ALL ".join(f"SELECT {quote(k)} AS pattern, doc_id, replace(substr(text, 1, 120), chr(10), ' ') AS example FROM ({LABELLED}) WHERE label <> 1 AND {base.sql_hit('text', p)}" for k, p in L.items())
    + f") WHERE pattern IN ({_WORST})) WHERE rk <= 3"
)
def r08_false_positive_examples(spark, d):
    """The three least precise of the patterns, three examples of each."""
    return mining.false_positives(labelled(spark, d), L, mining.per_pattern(_hist(spark, d), L), worst=3)
