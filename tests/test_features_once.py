"""Features are made once, for their means and for their rows."""

from pyspark.sql import functions as F

from textward.functions import features as ft
from textward.plans import job_queries


def test_features_made_once(spark):
    """The scaled features read a kept table, not the texts again; with_features gives what features gives."""
    plan = job_queries.m03_scaling(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in plan.lower() and "documents.parquet" not in plan
    texts = [None, "", " \n", "BUY NOW!!! http://bit.ly/a?ref=1 www.x.xyz", "a b c. d.e 1a ???", "ÄÖ Ünï \U0001f600 +7 999 123-45-67", "aaa (X) [yZ] 'q' !!"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = {tuple(r) for r in rows.select("doc_id", *ft.features(F.col("text"))).collect()}
    assert {tuple(r) for r in ft.with_features(rows, "text", ft.NAMES, ["doc_id"]).collect()} == want
