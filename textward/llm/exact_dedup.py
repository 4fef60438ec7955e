"""Exact dedup by skew-safe combining.

Texts are equal when identical after deleting white space. Three stages, each grouping on digest *and* full content:

1. local: Spark's partial aggregate merges equal texts inside each input task before anything is sent;
2. salted: the partial groups of a digest meet by (digest, salt, content); only hot digests have more than one salt,
   the input task's, so a digest with a third of all rows is spread over many tasks however alike its rows are;
3. global: the salt winners of a content are combined, at most one row of each salt.

Afterwards each row learns its group from a join on the digests of its content (SHA-256, a second hash, and length),
salted in the same way, without text. Should different contents ever share all three, as a count over the groups
tells, the rows of these digests compare whole contents in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, all_salts, hot_values, salt, text_of, written

SALTS = 64
_TWICE = "20000000000000000000"
_ID_SPAN = "10000000000000000000"  # above every id


def normalised(text: Column) -> Column:
    """The text without white space."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def _rank(length: Column, doc_id: Column) -> Column:
    """One decimal that orders by length, then by smallest id, null ids last."""
    span = F.lit(_ID_SPAN).cast("decimal(20,0)")
    back = F.coalesce((span - doc_id.cast("decimal(19,0)")).cast("decimal(21,0)"), F.lit(0).cast("decimal(21,0)"))
    return (length.cast("decimal(10,0)") * F.lit(_TWICE).cast("decimal(21,0)") + back).cast("decimal(38,0)")


def _digests(body: Column) -> list[Column]:
    """What a row's content is looked up by."""
    return [F.sha2(body, 256).alias("sha"), F.xxhash64(body).alias("second"), F.char_length(body).alias("body_len")]


def _marked(docs: DataFrame, carry: list[str], salts: int) -> DataFrame:
    """Rows with their group, equal rows (also in what is carried) as one with their number n, and whether one of them stays."""
    names = [f"carried_{i}" for i in range(len(carry))]
    text = text_of("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(text).alias("len"),
        F.xxhash64(text).alias("raw"),
        normalised(text).alias("body"),
        *[F.col(f"`{c}`").alias(n) for n, c in zip(names, carry)],
    )
    rows = rows.select("*", *_digests(F.col("body")))
    hot = hot_values(rows.select("sha"), "sha")
    # local and salted stages
    merged = (
        rows.select("sha", salt(F.col("sha"), hot, F.spark_partition_id(), salts).alias("salt"), "body", _rank(F.col("len"), F.col("doc_id")).alias("rank"), "raw")
        .groupBy("sha", "salt", "body")
        .agg(F.max("rank").alias("rank"), F.max_by("raw", "rank").alias("raw"), F.count(F.lit(1)).alias("n"))
    )
    # global stage
    span = F.lit(_TWICE).cast("decimal(21,0)")
    back = (F.col("rank") % span).cast("decimal(21,0)")
    whole = merged.groupBy("sha", "body").agg(F.max("rank").alias("rank"), F.max_by("raw", "rank").alias("keep_raw"), F.sum("n").alias("group_size"))
    whole = whole.select(
        *_digests(F.col("body")),
        "body",
        F.when(back > 0, (F.lit(_ID_SPAN).cast("decimal(20,0)") - back).cast("long")).alias("keep_id"),
        ((F.col("rank") - back) / span).cast("int").alias("keep_len"),
        "keep_raw",
        "group_size",
    )
    groups = written(whole.drop("body"), "dedup-groups")
    keys = ["sha", "second", "body_len"]
    if groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").limit(1).count():
        keys, groups = ["sha", "body"], whole.drop("second", "body_len")
    slim = rows.select(*keys, "doc_id", "len", "raw", *names)
    if hot:
        slim = slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("n"))  # equal rows of a task are one before they are sent
    else:
        slim = slim.withColumn("n", F.lit(1).cast("long"))
    slim = slim.withColumn("salt", salt(F.col("sha"), hot, F.hash("doc_id", "raw"), salts))
    joined = slim.join(groups.withColumn("salt", F.explode(all_salts(F.col("sha"), hot, salts))), [*keys, "salt"])
    winner = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len")) & (F.col("raw") == F.col("keep_raw"))
    # rows alike in id and text share all keys of the join, so this window needs no shuffle of its own
    first = F.row_number().over(Window.partitionBy(*keys, "salt", "doc_id", "len", "raw").orderBy(F.hash(*names) if names else F.lit(0)))
    return joined.withColumn("stays", winner & (first == 1))


def mark_copies(docs: DataFrame, carry: list[str] = (), salts: int = SALTS) -> DataFrame:
    """Every row of docs with its group of equal texts.

    Returns doc_id, keep_id, group_size, kept, text_sha256 and the columns in carry. Of equal texts the one with the
    most code points stays, then the smallest doc_id. Null texts count as empty (and so equal blank texts); null ids
    come after all others. Of rows alike in id and length one stays, so exactly one row of a group is kept, also where
    rows are repeated. Very long texts are compared whole; other columns are read only when carried. An empty table
    gives no rows.
    """
    rows = _marked(docs, carry, salts).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("stays") & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)],
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that equal a better one; same columns. Nulls, ties and repeats as in mark_copies."""
    columns = docs.columns
    wide = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(columns)])
    rows = _marked(wide, [f"in_{i}" for i in range(len(columns))], SALTS).where("stays")
    return rows.select(*[F.col(f"carried_{i}").alias(c) for i, c in enumerate(columns)])


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), w AS (
  SELECT doc_id, sha256(body) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY len DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
