"""Which sources of a language use its words differently: an audit of term shares.

A document is tokenised by one pass of bytes.translate, which lowers A-Z and blanks separators, and bytes.split; a
Counter per document gives term frequencies, its keys the document counts. Both are merged per task before anything is
sent, so the shuffle carries a row per task, language, source and term. Terms in too few documents of their language go;
what stays is sparse (a source's own terms) and small, and is written once.

Two sources' distance sums over all kept terms of the language, also those that one or both lack. A term that both lack
adds the same for all such terms, so only cells of the sparse table are visited: sources are cut into blocks of BLOCK,
terms into buckets, and each cell of two blocks and a bucket is one matrix of bounded size. Cells give sums per pair,
never rows per term and pair.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

LEAST_DOCS = 30
TOP_TERMS = 50
#: Terms that a task holds before it sends them on.
HELD = 400_000
#: Bytes of a text that are split at once.
SLICE = 1 << 20
#: Sources a block, and terms a bucket (on average), of a cell.
BLOCK = 256
TERMS_OF_CELL = 1000
#: What translate does: letters lower, bytes from 0x80 as they are, all else a space.
LOWER = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(raw: bytes, slice_bytes: int = SLICE) -> Counter:
    """The terms of a text with their frequencies. Long texts are split piece by piece, cut at separators."""
    raw = raw.translate(LOWER)
    if len(raw) <= slice_bytes:
        return Counter(raw.split())
    own, start = Counter(), 0
    while start < len(raw):
        end = raw.find(b" ", start + slice_bytes)
        end = len(raw) if end < 0 else end
        own.update(raw[start:end].split())
        start = end
    return own


def _merged(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), docs (documents) of a task's documents; a key may come again later."""

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in often.items():
            docs = within[lang, source]
            columns = {"term": pa.array(terms.keys(), pa.binary()), "n": pa.array(terms.values(), pa.int64()), "docs": pa.array([docs[t] for t in terms], pa.int64())}
            size = len(terms)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * size, pa.string()), "source": pa.array([source] * size, pa.string()), **columns})

    often, within, held = defaultdict(Counter), defaultdict(Counter), 0
    for batch in batches:
        for lang, source, raw in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("raw")):
            own = terms_of(raw.as_py())
            terms = often[lang, source]
            before = len(terms)
            for term, n in own.items():
                terms[term] += n
            within[lang, source].update(own.keys())
            held += len(terms) - before
            if held > most:
                yield from out()
                often, within, held = defaultdict(Counter), defaultdict(Counter), 0
    yield from out()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of("text").alias("text"))


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term (bytes), n, lang_n: occurrences of the terms in at least `least_docs` documents of their language."""
    rows = _keyed(docs).select("lang", "source", F.col("text").cast("binary").alias("raw"))
    found = rows.mapInArrow(_merged, "lang string, source string, term binary, n long, docs long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    found = found.withColumns({"lang_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term)})
    return found.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n")


def share(n: Column, total: Column, kinds: Column) -> Column:
    """The smoothed share in billionths, in whole numbers: decimals hold the product exactly."""
    wide = "decimal(19,0)"
    smooth = ((n + 5).cast(wide) * F.lit(1_000_000_000).cast(wide)).cast("decimal(38,0)")
    room = (total + 5 * kinds).cast("decimal(38,0)")
    return ((smooth - smooth % room) / room).cast("long") + 1


def groups_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Every (lang, source) of docs: number (from 0) among the sources of lang, total, lang_total, kinds (V), none (share of a term it lacks)."""
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = terms.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("lang_n").alias("lang_total"))
    rows = _keyed(docs).select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "kinds"])
    of_lang = Window.partitionBy("lang")
    rows = rows.withColumns({"number": F.row_number().over(of_lang.orderBy("source")) - 1, "sources": F.count(F.lit(1)).over(of_lang)})
    return rows.withColumn("none", F.when(F.col("kinds") > 0, share(F.lit(0), F.col("total"), F.col("kinds"))).otherwise(0))


def _cells(rows: DataFrame, buckets: Column) -> DataFrame:
    """rows (with number and sources) for every cell of blocks and buckets in which their source takes part."""
    own, last = F.floor(F.col("number") / BLOCK).cast("int"), F.floor((F.col("sources") - 1) / BLOCK).cast("int")
    rows = rows.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return rows.select("*", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.explode(buckets).alias("bucket"))


def _cell_sums(block: int):
    """Of a cell, for each pair of its sources: the sum of differences over its terms, less what lacked terms would add."""

    def work(key: tuple, terms: pa.Table, sources: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        numbers = sources.column("number").to_numpy()
        order = np.argsort(numbers)
        numbers, none = numbers[order], sources.column("none").to_numpy()[order]
        which = terms.column("term").combine_chunks().dictionary_encode()
        shares = np.tile(none, (len(which.dictionary), 1))
        shares[which.indices.to_numpy(), np.searchsorted(numbers, terms.column("number").to_numpy())] = terms.column("share").to_numpy()
        left, right = np.flatnonzero(numbers // block == low), np.flatnonzero(numbers // block == high)
        a, b, extra = [], [], []
        for x in left if len(shares) else []:
            to = right[right > x] if low == high else right
            a += [numbers[x]] * len(to)
            b += numbers[to].tolist()
            extra += (np.abs(shares[:, [x]] - shares[:, to]).sum(axis=0) - len(shares) * np.abs(none[x] - none[to])).tolist()
        columns = {"a": a, "b": b, "extra": extra}
        return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string())} | {c: pa.array(x, pa.int64()) for c, x in columns.items()})

    return work


def pair_distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of it), value: the summed difference of their shares over all kept terms.

    shares has the terms of each source with the columns of groups.
    """
    last = F.floor(F.col("kinds") / TERMS_OF_CELL).cast("int")
    terms = _cells(shares, F.array(F.pmod(F.xxhash64("term"), last + 1).cast("int"))).select("lang", "low", "high", "bucket", "term", "number", "share")
    around = _cells(groups.where("kinds > 0"), F.sequence(F.lit(0), last))
    cell = ["lang", "low", "high", "bucket"]
    around = around.select(*cell, "number", "none").toDF(*cell, "number", "none")  # columns of its own beside those in terms
    sums = terms.groupBy(*cell).cogroup(around.groupBy(*cell)).applyInArrow(_cell_sums(BLOCK), "lang string, a long, b long, extra long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra"))
    one = groups.select("lang", "source", "kinds", F.col("number").alias("x"), F.col("none").alias("x_none"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("y"), F.col("none").alias("y_none"))
    pairs = one.join(two, "lang").where("x != y").withColumns({"a": F.least("x", "y").cast("long"), "b": F.greatest("x", "y").cast("long")})
    value = F.coalesce("extra", F.lit(0)) + F.col("kinds") * F.abs(F.col("x_none") - F.col("y_none"))
    return pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", value.alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: a source's distance to the others of its language, and the terms it has too often.

    Part `pair` has every other source, part `term` the `top` terms whose share exceeds the language's the most. Null
    text, lang and source are ''; a source without terms is compared like any other, one alone in its language has no
    pair; a language without kept terms gives distances of 0. Ties rank by item's bytes; repeated rows count each time.
    Texts of any length are read whole; other columns are not read. An empty table gives no rows.
    """
    terms = written(term_counts(docs, least_docs), "divergence-terms")
    groups = written(groups_of(docs, terms), "divergence-groups")
    shares = terms.join(groups.drop("none"), ["lang", "source"]).withColumns(
        {"share": share(F.col("n"), F.col("total"), F.col("kinds")), "usual": share(F.col("lang_n"), F.col("lang_total"), F.col("kinds"))}
    )
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = pair_distances(shares, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked)
    often = shares.where("share > usual").select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("share") - F.col("usual")).alias("value"))
    often = often.select("lang", "source", F.lit("term").alias("part"), "item", "value", ranked).where(F.col("rank") <= top)
    return pairs.union(often)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT row_number() OVER () AS k, lang, source, text FROM d
), t AS (
  SELECT k, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM w
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30
), own AS (
  SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term
), groups AS (
  SELECT DISTINCT lang, source FROM d
), cells AS (
  SELECT g.lang, g.source, kept.term, coalesce(own.n, 0)::HUGEINT AS n, kept.lang_n::HUGEINT AS lang_n
  FROM groups g JOIN kept ON g.lang = kept.lang LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term
), sums AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source)::HUGEINT AS total, sum(lang_n) OVER (PARTITION BY lang, source)::HUGEINT AS lang_total,
         count(*) OVER (PARTITION BY lang, source)::HUGEINT AS kinds FROM cells
), shares AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * kinds) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * kinds) AS q FROM sums
), pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
  FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), found AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(p.value, 0) AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
