"""Folds of the searches, and what is sent for them."""

from pyspark.sql import functions as F

from textward.operators import grams, models
from textward.operators.corpus import split


def _frame(spark):
    rows = [(k, f"text {k} " + "word " * (k % 5), k % 3 == 0) for k in range(60)] + [(7, "other text", False), (7, "other text", False), (8, "third", True)]
    return spark.createDataFrame([(k, t, int(y)) for k, t, y in rows], "doc_id long, text string, label int")


def test_folds_by_keys(spark):
    """Each row has its own rank of its label, as where texts take part in the dealing."""
    frame = _frame(spark)
    got = models._dealt(frame, 3, None, "doc_id")[0]
    want = split(frame, "label", "doc_id", {"all": 1.0}).withColumn("fold", (F.col("rank") % 3).cast("int"))
    by_key = lambda df: sorted(map(tuple, df.select("doc_id", "label", "fold").collect()))  # noqa: E731  (rows of a key are alike here)
    assert by_key(got) == by_key(want) and got.count() == 63
    assert got.select("doc_id", "text", "label").exceptAll(frame).count() == 0


def test_texts_sent_once(spark):
    """Texts that come joined by key are not sent again, neither for folds nor for equal rows."""
    frame = _frame(spark)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = frame.select("doc_id", "text").join(frame.select("doc_id", "label").distinct(), "doc_id")
        rows = models._made(models._dealt(joined, 2, None, "doc_id")[0].withColumn("h", F.xxhash64("text")), "toxicity")
        node, sent = rows._jdf.queryExecution().executedPlan(), 0
        left = [node]
        while left:
            node = left.pop()
            children = node.children()
            left += [children.apply(i) for i in range(children.size())]
            names = [node.output().apply(i).name() for i in range(node.output().size())]
            sent += node.nodeName() == "Exchange" and "text" in names
        assert sent == 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_sums_from_few_tasks(spark):
    """However many tasks hold the texts, few of them send a line per term."""
    texts = spark.range(0, 2000, 1, 50).select(F.array(F.concat(F.lit("same words "), F.col("id").cast("string"))).alias("made"), F.lit(0).alias("fold"), F.lit(1).alias("n1"), F.lit(0).alias("n0"), F.lit(1).alias("n"))
    terms = spark.createDataFrame([(0, "all", " sa", 1.0), (0, "all", "ame", 1.0)], "model int, part string, term string, idf double")
    sent = []
    for made in (grams.class_sums(texts, grams.Vocabularies(terms, 1, ["all"]), [(-1, True, "l2")], (3, 4)), grams.totals(texts, ["all"], (3, 4))):
        assert made.count() > 0
        sent.append(f"Coalesce {grams.TASKS * spark.sparkContext.defaultParallelism}" in made._jdf.queryExecution().executedPlan().toString())
    assert all(sent)
    total = {r["term"]: (r["total"], r["df"]) for r in grams.totals(texts, ["all"], (3, 4)).collect()}
    assert total[" sa"] == (2000, 2000)
