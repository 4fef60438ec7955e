"""N-grams in Arrow batches against the same in built-in expressions, and repeated rows as SQL has them."""

from pyspark.sql import functions as F

from textward.functions import text as tx
from textward.operators import grams, metrics, models
from textward.plans import eval_queries


def test_counts_as_built_in(spark):
    """Odd white space, letters beyond 16 bits, short and very long words: the same terms, totals and documents."""
    texts = ["aa bb aa", "a", "", "ab ab c\x1cd", "\U0001f600x \U0001f600xy", "long" * 500 + " aa", "ß ſ İ ё"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, made string")
    for sizes in ((3, 4), (2, 3), (2, 5)):
        want = tx.gram_counts(rows, ["doc_id"], F.col("made"), *sizes).groupBy("term").agg(F.sum("tf"), F.count(F.lit(1)))
        got = grams.totals(rows.select(F.array("made").alias("made")), ["all"], sizes).select("term", "total", "df")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), sizes
        per = {r["doc_id"]: {} for r in rows.collect()}
        for r in tx.gram_counts(rows, ["doc_id"], F.col("made"), *sizes).collect():
            per[r["doc_id"]][r["term"]] = r["tf"]
        known = {g: k for k, g in enumerate(sorted({g for d in per.values() for g in d})[::2])}
        names = list(known)
        cutter = grams.Counts(sizes, known)
        for k, t in enumerate(texts):
            assert {names[i]: n for i, n in zip(*map(list, cutter(t)))} == {g: n for g, n in per[k].items() if g in known}, (sizes, k)


def test_repeated_ids(spark, monkeypatch):
    """Rows of one id are one document in a term's share, and one text with several labels for naive Bayes."""
    rows = spark.createDataFrame([(1, "aa bb", 1), (1, "aa cc", 1), (2, "bb", 0), (2, "bb", 0), (3, "aa cc", 0)], "doc_id int, text string, label int")
    monkeypatch.setattr(eval_queries, "labelled", lambda spark, d: rows)
    found = {r["term"]: (r["d1"], r["d0"]) for r in eval_queries.a13_term_lift(spark, "").collect()}
    assert found == {"aa": (1, 1), "bb": (1, 1), "cc": (1, 1)}
    model = models.fit_bayes(rows)
    got = {tuple(r) for r in models.score_merged(model, rows).select("doc_id", "score").collect()}
    assert len(got) == 3 and models.score_merged(model, rows).count() == 5


def test_term_lift_at_ties(spark):
    """Shares that lie between two rounded numbers go where DuckDB takes them; by their printed digits 41 of 640 would be 0.064063."""
    import duckdb

    shares = [(41, 640), (323, 640), (201, 3200), (246, 3840), (1, 128), (0, 640)]
    for n1, n0 in ((640, 3200), (3840, 640)):
        rows = spark.range(n1 + n0).select(F.when(F.col("id") < n1, 1).otherwise(0).alias("label"))
        terms = spark.createDataFrame([(f"t{d}", y) for d, n in shares for y in (1, 0) if n == (n1, n0)[1 - y] for _ in range(d)], "term string, label int")
        got = {r["term"]: (r["rate_1"], r["rate_0"]) for r in metrics.term_lift(terms, rows).collect()}
        for d, n in shares:
            want = duckdb.execute("SELECT round(?::DOUBLE / ?, 6)", [d, n]).fetchone()[0]
            if d and n in (n1, n0):
                assert got[f"t{d}"][0 if n == n1 else 1] == want, (d, n)
