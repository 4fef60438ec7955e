"""Term totals merged as new n-grams come, and vectors that carry further numbers."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from textward.operators import grams


def _rows(texts):
    return [(k, [t], float(k), -0.5 * k) for k, t in enumerate(texts)]


SCHEMA = "id int, made array<string>, x double, y double"


def test_totals_of_more_terms_than_are_merged_at_once(spark):
    drawn = random.Random(3)
    words = ["".join(drawn.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(30_000)]
    texts = [" ".join(drawn.choices(words, k=1000)) for _ in range(60)] + ["", "a", "a a b"]
    total, df = Counter(), Counter()
    for t in texts:
        own = Counter(g for w in t.split() for g in grams.cut(w, 3, 4))
        total.update(own)
        df.update(own.keys())
    assert len(total) > grams.TERMS // 8
    found = grams.totals(spark.createDataFrame(_rows(texts), SCHEMA).coalesce(1), ["all"], (3, 4), F.col("id") * 0)
    got = {r["term"]: (r["total"], r["df"]) for r in found.collect()}
    assert got == {g: (total[g], df[g]) for g in total}


def test_vectors_end_with_further_numbers(spark):
    known = grams.Vocabularies(spark.createDataFrame([(0, "all", t, i) for t, i in ((" ab", 1.0), ("ab ", 2.0), ("bc ", 1.0))], "model int, part string, term string, idf double"), 1, ["all"])
    texts = spark.createDataFrame(_rows(["ab abc", "", "xyz", "ab"]), SCHEMA)
    got = {r["id"]: (r["idx"], r["w"]) for r in grams.vectors(texts, known, False, "l1", (3, 4), ["id"], [F.col("x") + 1, F.col("y")]).collect()}
    plain = {r["id"]: (r["idx"], r["w"]) for r in grams.vectors(texts, known, False, "l1", (3, 4), ["id"]).collect()}
    assert plain == {0: ([0, 1, 2], [0.4, 0.4, 0.2]), 1: ([], []), 2: ([], []), 3: ([0, 1], [1 / 3, 2 / 3])}
    assert got == {k: (idx + [3, 4], w + [k + 1.0, -0.5 * k]) for k, (idx, w) in plain.items()}
