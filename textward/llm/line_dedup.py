"""Line dedup on overlapping three-line windows.

Every run of three consecutive lines is hashed. Windows found more than once in the corpus keep their first occurrence;
the lines that later occurrences cover are removed, overlapping occurrences merged. Only hashes and positions are
shuffled to find the repeats (partial aggregation first, so a window found in a third of all rows is no hot group);
the text itself moves once, when the covered positions return to their document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, all_salts, hot_values, salt, text_of, written

LINES = 3
SALTS = 64


def strip_repeats(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Every document without the lines that later occurrences of repeated windows cover.

    Returns doc_id, text (the lines that stay, joined by \\n), n_lines, n_removed and the columns in carry. Lines are
    what \\n separates; a null text counts as empty (one blank line); texts under three lines have no window and stay.
    Three lines without a word are no window. Occurrences are ordered by doc_id (nulls last), hash of the text, line.
    Rows alike in id and text are one document in this order: each gets the same result, and they do not remove each
    other's lines.
    """
    names = [f"carried_{i}" for i in range(len(carry))]
    text = text_of("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text)).alias("row"),
        *[F.col(f"`{c}`").alias(n) for n, c in zip(names, carry)],
    )
    lined = rows.select("doc_id", "row", F.split("text", "\n").alias("lines")).where(F.size("lines") >= LINES)
    window = lambda i: F.md5(F.concat_ws("\n", *[F.element_at("lines", i + k) for k in range(LINES)]))
    blank = lambda i: ~F.concat(*[F.element_at("lines", i + k) for k in range(LINES)]).rlike(WORD)
    found = lined.select(
        F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row").alias("doc"),
        F.posexplode(F.transform(F.sequence(F.lit(1), F.size("lines") - (LINES - 1)), lambda i: F.when(~blank(i), window(i)))).alias("at", "hash"),
    ).where("hash is not null")
    found = written(found, "line-windows")
    first = found.groupBy("hash").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = hot_values(found, "hash")
    first = first.select("hash", "first", F.explode(all_salts(F.col("hash"), hot, SALTS)).alias("salt"))
    later = (
        found.withColumn("salt", salt(F.col("hash"), hot, F.col("doc.row"), SALTS))
        .join(first, ["hash", "salt"])
        .where((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at")))
    )
    covered = later.groupBy(F.col("doc.row").alias("row")).agg(F.collect_set("at").alias("starts"))
    # rows alike in id and text meet their one line of covered positions over salted keys; a small table is broadcast by its size
    alike = hot_values(rows.select("row"), "row")
    covered = covered.withColumn("salt", F.explode(all_salts(F.col("row"), alike, SALTS)))
    out = rows.withColumn("salt", salt(F.col("row"), alike, F.monotonically_increasing_id(), SALTS)).join(covered, ["row", "salt"], "left")
    lines = F.split("text", "\n")
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (LINES - 1)))))
    out = out.select("doc_id", "text", *names, lines.alias("lines"), F.coalesce(F.array_sort(gone), F.array().cast("array<int>")).alias("gone"))
    # covered positions, merged to runs: keep the slices between them
    cuts = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    out = out.withColumn("cuts", cuts)
    gaps = F.filter(
        F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.struct(F.element_at("cuts", i).alias("a"), F.element_at("cuts", i + 1).alias("b"))),
        lambda g: g["b"] - g["a"] > 1,
    )
    kept = F.flatten(F.transform(gaps, lambda g: F.slice("lines", g["a"] + 2, g["b"] - g["a"] - 1)))
    return out.select(
        "doc_id",
        F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        *[F.col(n).alias(c) for n, c in zip(names, carry)],
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(text, '')) AS row_key FROM documents
), l AS (
  SELECT doc_id, text, row_key, string_split(text, chr(10)) AS lines FROM d
), u AS (
  SELECT DISTINCT doc_id, row_key, unnest(range(0, len(lines) - 2)) AS pos0, lines FROM l WHERE len(lines) >= 3
), w AS (
  SELECT doc_id, row_key, pos0, array_to_string(lines[pos0 + 1 : pos0 + 3], chr(10)) AS win FROM u
  WHERE regexp_matches(lines[pos0 + 1] || lines[pos0 + 2] || lines[pos0 + 3], '[^\x20\x09-\x0D]')
), r AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, row_key, pos0) AS rn FROM w
), g AS (
  SELECT DISTINCT row_key, unnest([pos0, pos0 + 1, pos0 + 2]) AS pos FROM r WHERE rn > 1
), gl AS (
  SELECT row_key, list(pos) AS gone FROM g GROUP BY row_key
)
SELECT l.doc_id,
       array_to_string(list_transform(list_filter(range(0, len(l.lines)), lambda i: NOT list_contains(coalesce(gl.gone, []), i)), lambda i: l.lines[i + 1]), chr(10)) AS text,
       len(l.lines)::BIGINT AS n_lines, len(coalesce(gl.gone, []))::BIGINT AS n_removed
FROM l LEFT JOIN gl ON l.row_key = gl.row_key
"""
