"""What op13's postings weigh, and texts that several tasks hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from textward.llm import ngram_join

NONE = np.array([], dtype=np.uint64)


def _texts(n: int, words: int, seed: int) -> list[str]:
    drawn = np.random.Generator(np.random.PCG64(seed)).integers(0, 10**9, (n, words))
    return [" ".join(map(str, row)) for row in drawn.tolist()]


def test_postings_weigh_alike_in_any_number_of_buckets(spark):
    docs = spark.createDataFrame(list(enumerate(_texts(300, 80, 1))), "doc_id long, text string").coalesce(1)

    def weighed(bits: int) -> int:
        packed = ngram_join.postings(docs, bits, NONE)
        return packed.agg(sum((F.sum(F.coalesce(F.length(c), F.lit(0))) for c, kind in packed.dtypes if kind == "binary"), F.lit(0))).first()[0]

    assert weighed(9) <= 1.02 * weighed(0)  # a text's name (12 bytes) came with almost each shingle before


def test_copies_in_several_tasks_are_no_partners(spark, monkeypatch):
    texts = _texts(60, 40, 2)
    words = texts[0].split()
    near = " ".join(words[:-1] + ["other"])  # 36 of 38 shingles shared
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t) for k, t in enumerate(texts[:30])] + [(200 + k, t) for k, t in enumerate(texts[:20])] + [(300, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(ngram_join, "BLOCK", 75)  # blocks of a few texts
    monkeypatch.setattr(ngram_join, "SEEN", 3)  # so that a task, too, posts a text again
    monkeypatch.setattr(ngram_join, "BUCKET", 200)
    found = ngram_join.candidates(docs, ngram_join.sized(docs).cache()).collect()
    assert sorted(len(r["tokens"]) // 8 for r in found) == [36, 36]
    ids = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()}
    want = {k: k % 100 for k, _ in rows} | {300: 0}
    assert ids == want
