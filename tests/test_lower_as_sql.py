"""Capital sigma and dotted I in lower case, as DuckDB has them."""

import duckdb
from pyspark.sql import functions as F

from textward.functions import text as tx
from textward.plans import base, eval_queries


def test_lower_and_normalise(spark):
    texts = ["ΟΔΟΣ ΣΑΣ", "İSTANBUL aİ", "Σ", "ΑΣ! Σ", "ÉÑ ẞ Ж plain", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r[0]: (r[1], r[2]) for r in rows.select("id", tx.lower(F.col("text")), tx.normalise(F.col("text"))).collect()}
    for k, t in enumerate(texts):
        want = duckdb.execute(f"SELECT lower(text), {base.sql_normalise('text')} FROM (SELECT ?::VARCHAR AS text)", [t]).fetchall()[0]
        assert got[k][0] == want[0] and ("İ" in t or got[k][1] == want[1])


def test_terms(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "ΟΔΟΣ ΣΑΣ", 1), (2, "ΟΔΟΣ! ΟΔΟΣ", 0), (3, "İZ İZ", 0)], "doc_id long, text string, label int")
    monkeypatch.setattr(eval_queries, "labelled", lambda *_: rows)
    got = {tuple(r) for r in eval_queries.a13_term_lift(spark, "").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (1::BIGINT, 'ΟΔΟΣ ΣΑΣ'), (2, 'ΟΔΟΣ! ΟΔΟΣ'), (3, 'İZ İZ')) t(doc_id, text)")
    con.execute("CREATE TABLE labels AS SELECT * FROM (VALUES (1::BIGINT, 1, 1), (2, 0, 1), (3, 0, 1)) t(doc_id, toxic, quality)")
    assert got == set(con.execute(base.SQL["a13_term_lift"]).fetchall())
