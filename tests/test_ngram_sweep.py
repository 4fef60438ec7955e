"""The n-gram sweep without a row per text and n-gram."""

import duckdb
from pyspark.sql import functions as F

from textward.operators import metrics
from textward.plans import base


def test_sweep_without_rows_of_grams(spark):
    """The sweep reads kept totals: no explode is planned. Rows of one id are one text, as in SQL, and least sizes beyond 3 count short words."""
    texts = [(1, "aa bb aa"), (1, "aa c"), (2, None), (3, "c d \x1c bb"), (None, "aa longer words"), (None, "aa")]
    rows = spark.createDataFrame(texts, "doc_id int, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("made"))
    settings = [(2, 3, 4), (2, 3, 1000), (3, 4, 1000), (4, 5, 1000)]
    found = metrics.ngram_sweep(rows, settings)
    assert "generate" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id INT, made VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", [(i, t or "") for i, t in texts])
    for r in found.collect():
        grams = base.sql_gram_counts("d", "made", r["least"], r["most"])
        top = f"SELECT count(*) AS df FROM ({grams}) GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {r['max_features']}"
        assert con.execute(f"SELECT count(*), round(sum(df)::DOUBLE / {len(texts)}, 4) FROM ({top})").fetchone() == (r["vocabulary"], r["nonzeros_per_doc"]), r
