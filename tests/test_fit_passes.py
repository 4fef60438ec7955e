"""The logistic fit by passes over packed rows, against Spark ML's on vectors, and scores without a shuffle of the texts."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from textward.operators import grams, models
from textward.operators.metrics import class_weights

WORDS = "good fine text here bad awful junk there ПРИЗ СКИДКА new odd".split()


def _frame(spark, n=60):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(WORDS[:7] if k % 3 else WORDS[3:]) for _ in range(rng.randint(1, 12))), int(k % 3 == 0)) for k in range(n)]
    return spark.createDataFrame([*rows, (900, "", 1), (901, "zz", 0), (902, None, 0)], "doc_id long, text string, label int")


@pytest.mark.parametrize("flavour, more", [("toxicity", {}), ("spam", {"names": None}), ("dual", {"sublinear": False, "norm": "l1"}), ("toxicity", {"use_idf": False, "min_df": 1})])
def test_as_spark_ml(spark, monkeypatch, flavour, more):
    """Coefficients and intercept of the same vectors; nothing but sums comes of a pass, also where lines are added up first."""
    frame = _frame(spark)
    names = models._names(flavour, more.get("names"))
    own = {"size": 200, "min_df": 2, "max_df": 1.0, "sublinear": True, "use_idf": True, "norm": "l2"} | {k: v for k, v in more.items() if k != "names"}
    vectors, terms, _ = models._training(*models._counted(frame, "doc_id", flavour, (3, 4), names), "doc_id", names, own["size"], own["min_df"], own["max_df"], own["sublinear"], own["use_idf"], own["norm"], (3, 4), flavour)
    weight = {r["label"]: r["weight"] for r in class_weights(vectors).collect()}
    want = LogisticRegression(weightCol="w", regParam=1.0 / (0.5 * vectors.count()), standardization=False, maxIter=50).fit(vectors.withColumn("w", F.when(F.col("label") == 1, weight[1.0]).otherwise(weight[0.0])))
    by_term = {(r["part"], r["term"]): want.coefficients[r["idx"]] for r in terms.collect()}
    monkeypatch.setattr(models, "LogisticRegression", None, raising=False)
    monkeypatch.setattr(grams, "PASS", 7)
    for lines in (64, 2):
        monkeypatch.setattr(grams, "LINES", lines)
        model = models.fit(frame, flavour, c=0.5, names=more.get("names"), **own)
        assert model.intercept == pytest.approx(want.intercept, abs=1e-6)
        found = {(r["part"], r["term"]): r["coefficient"] for r in model.terms.collect()}
        assert found.keys() == by_term.keys() and [found[k] for k in by_term] == pytest.approx(list(by_term.values()), abs=1e-6)
        assert [x[3] for x in model.extra] == pytest.approx(list(want.coefficients)[len(by_term):], abs=1e-6)


def test_one_class(spark):
    for y, want in ((1, math.inf), (0, -math.inf)):
        model = models.fit(_frame(spark, 6).withColumn("label", F.lit(y)))
        assert model.intercept == want and all(r["coefficient"] == 0.0 for r in model.terms.collect())
    with pytest.raises(ValueError):
        models.fit(_frame(spark, 6).withColumn("label", F.lit(2)))


def test_large_counts(spark):
    """A count beyond 16 bits and beyond the table of logarithms is packed as it is."""
    frame = spark.createDataFrame([(1, "ab " * 70_000 + "cd", 1.0), (2, "ab cd", 0.0), (3, "cd", 1.0)], "doc_id long, made string, label double").select("label", F.array("made").alias("made"))
    terms = spark.createDataFrame([(0, "all", " ab", 2.0), (0, "all", " cd", 1.0)], "model int, part string, term string, idf double")
    known = grams.Vocabularies(terms.orderBy("term"), 1, ["all"])
    rows = grams.Rows(grams.packed(frame, known, "l1", True, (3, 4), ["label"]), known, True, 0, (1.0, 1.0))
    a = 2 * (1 + math.log(70_000)) / (2 * (1 + math.log(70_000)) + 1)
    x = [(a, 1 - a), (2 / 3, 1 / 3), (0.0, 1.0)]
    one, two = rows.moments()
    assert one == pytest.approx([sum(r[k] for r in x) for k in (0, 1)]) and two == pytest.approx([sum(r[k] ** 2 for r in x) for k in (0, 1)])
    value, slope, by_intercept = rows.slope(np.array([1.0, -1.0]), 0.0)
    margin, label = [p - q for p, q in x], (1, 0, 1)
    error = [1 / (1 + math.exp(-m)) - y for m, y in zip(margin, label)]
    assert by_intercept == pytest.approx(sum(error)) and slope == pytest.approx([sum(e * r[k] for e, r in zip(error, x)) for k in (0, 1)])
    assert value == pytest.approx(sum(math.log1p(math.exp(-m if y else m)) for m, y in zip(margin, label)))


def test_fit_holds_no_vectors(spark, monkeypatch):
    """Spark ML's fit would keep all vectors in the executors' memory."""
    monkeypatch.setattr(LogisticRegression, "fit", lambda *_: pytest.fail("all rows held"))
    monkeypatch.setattr(grams, "vectors", lambda *_, **__: pytest.fail("vectors written"))
    assert models.fit(_frame(spark), "spam").extra


def test_scores_where_rows_are(spark):
    """Rows of a table are judged in their own tasks: no text is shuffled; each row, repeated ones too, has its score."""
    frame = _frame(spark)
    model = models.fit(frame, "spam")
    twice = frame.unionByName(frame.where("doc_id < 5"))
    near = models.score(model, twice, dealt=False)
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    want = {r["doc_id"]: r["score"] for r in models.scores(model, frame).collect()}
    got = near.collect()
    assert len(got) == frame.count() + 5 and sorted(map(tuple, got)) == sorted(map(tuple, models.score(model, twice).collect()))
    assert all(r["score"] == pytest.approx(want.get(r["doc_id"], 0.0), abs=1e-6) for r in got)
