"""A Merkle manifest: one digest for all documents, and for each a proof against it.

Leaves of a language get their rank from sorted ranges: the position inside a range plus the ranges before it, so no
language is numbered in one task. The rank's base-8 digits are a leaf's way through the tree. Inside a bounded block of
8 ** DIGITS leaves, which meet in one shuffle, the digit columns are grouped away one after another: each grouping
collects the children's structs, sorted by digit, into their parent's struct. A block's row is then its whole subtree.
Blocks are the nodes of the next tier, up to one node per language; the languages' nodes make a tree of the same kind.

The way back down starts at the root. A block's subtree and the proof of the block itself meet in a grouping, and
transform and explode hand each child its siblings, tier by tier, so proofs are never joined to leaves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ARITY_BITS = 3
#: Digits of a block: 512 leaves, about 100 KB.
DIGITS = 3
FORGED = 3
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SIDES = "array<struct<left: string, right: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_digest(columns: dict[str, Column]) -> Column:
    """The digest of a row's fields: `-` for null, else the number of bytes, a colon and the value."""
    values = [columns[name].cast("string") for name in _FIELDS]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, tree (the language as a key that sorts null first), leaf, forged (the leaf of a tampered row), tie."""
    own = {name: F.col(name) for name in _FIELDS}
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FORGED == 0
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        leaf_digest(own).alias("leaf"),
        F.when(chosen, leaf_digest(own | {"text": lower})).alias("forged"),
        F.monotonically_increasing_id().alias("tie"),
    )


def ranked(nodes: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """nodes with their rank (from 0) within tree and that tree's depth; and the sizes: tree, nodes, depth.

    The rows are sorted by ranges and written; a row's number inside its file part gives its place, a table of a row per
    range and tree the offset.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    rows = written(rows, f"{name}-sorted").withColumn("range", F.shiftright("at", 33))
    spans = rows.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("range")
    spans = spans.withColumns({"offset": F.sum("n").over(before) - F.col("n"), "nodes": F.sum("n").over(Window.partitionBy("tree"))})
    depth = reduce(lambda a, k: a + (F.col("nodes") > 8**k).cast("int"), range(21), F.lit(0))
    spans = written(spans.withColumn("depth", depth), f"{name}-spans")
    own = rows.join(spans.select("tree", "range", "first", "offset", "depth"), ["tree", "range"])
    return own.withColumn("rank", F.col("at") - F.col("first") + F.col("offset")), spans.select("tree", "nodes", "depth").distinct()


def blocks(nodes: DataFrame, level: int, data: list[str]) -> DataFrame:
    """tree, depth, block, hash, kids: the subtree of each block of nodes (tree, depth, rank, hash and data) at a level.

    Levels from a tree's depth on have one node and pass it on as it is.
    """
    digits = [f"digit_{k}" for k in range(DIGITS)]
    rows = nodes.withColumns({d: F.shiftright("rank", ARITY_BITS * k).bitwiseAND(F.lit(7)).cast("int") for k, d in enumerate(digits)})
    rows = rows.withColumn("block", F.shiftright("rank", ARITY_BITS * DIGITS)).repartition("tree", "block")
    node = F.struct(F.col(digits[0]).alias("digit"), "hash", *data)
    for k in range(DIGITS):
        rows = rows.groupBy("tree", "depth", "block", *digits[k + 1 :]).agg(F.sort_array(F.collect_list(node)).alias("kids"))
        rows = rows.withColumn("hash", F.when(F.col("depth") > level + k, digest(F.array_join("kids.hash", ""))).otherwise(F.col("kids")[0]["hash"]))
        if k + 1 < DIGITS:
            node = F.struct(F.col(digits[k + 1]).alias("digit"), "hash", "kids")
    return rows


def rolled_up(nodes: DataFrame, depth: int, data: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of blocks over nodes, lowest first, and the one node that is left of each tree: tree, hash."""
    tiers, level = [], 0
    while True:
        tiers.append(written(blocks(nodes, level, [] if tiers else data), f"{name}-{level}"))
        level += DIGITS
        nodes = tiers[-1].select("tree", "depth", F.col("block").alias("rank"), "hash")
        if level >= depth:
            return tiers, nodes.select("tree", "hash")


def proofs(tiers: list[DataFrame], start: DataFrame) -> DataFrame:
    """The nodes of the lowest tier with their path, a (left, right) pair of sibling digests for each level upwards.

    start has a row per tree: tree, top (whatever is handed down), path (the tree's own path).
    """
    paths = start.select("tree", F.lit(0).cast("long").alias("block"), "top", "path")
    for k in reversed(range(len(tiers))):
        tier, level = tiers[k], k * DIGITS
        kinds = dict(tier.dtypes)
        subtrees = tier.select("tree", "block", "depth", "kids", F.lit(None).cast("string").alias("top"), F.lit(None).cast(_SIDES).alias("path"))
        above = paths.select("tree", "block", F.lit(None).cast("int").alias("depth"), F.lit(None).cast(kinds["kids"]).alias("kids"), "top", "path")
        one = [F.first(c, ignorenulls=True).alias(c) for c in ("depth", "kids", "top", "path")]
        rows = subtrees.unionByName(above).groupBy("tree", "block").agg(*one).withColumnRenamed("block", "rank")
        for step in reversed(range(DIGITS)):
            hashes = F.col("kids.hash")
            sides = F.transform("kids", lambda kid, i: F.struct(kid.alias("kid"), F.array_join(F.slice(hashes, 1, i), "").alias("left"), F.array_join(F.slice(hashes, i + 2, 8), "").alias("right")))
            rows = rows.select("tree", "rank", "depth", "top", "path", F.explode(sides).alias("own"))
            own = F.array(F.struct("own.left", "own.right"))
            rows = rows.select(
                "tree", (F.col("rank") * 8 + F.col("own.kid.digit")).alias("rank"), "depth", "top",
                F.when(F.col("depth") > level + step, F.concat(own, "path")).otherwise(F.col("path")).alias("path"),
                F.col("own.kid.kids").alias("kids") if step else F.col("own.kid").alias("node"),
            )
        paths = rows.withColumnRenamed("rank", "block")
    return paths.withColumnRenamed("block", "rank")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Leaves of a language ascend by doc_id, null ids first; rows alike in id come in order of their leaf, equal rows are
    leaves of their own. Null fields are `-` and so differ from empty ones; a null language is a tree of its own. A row
    without siblings on its way has the digest of the empty text as proof. Texts are hashed whole, other columns are not
    read. An empty table gives no rows.
    """
    own, sizes = ranked(written(leaves(docs), "leaves"), ["doc_id", "leaf", "tie"], "leaves")
    depth = sizes.agg(F.max("depth")).first()[0] or 0
    nodes = own.select("tree", "depth", "rank", F.col("leaf").alias("hash"), "doc_id", "forged")
    tiers, subroots = rolled_up(nodes, depth, ["doc_id", "forged"], "leaf-blocks")
    langs = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "hash")
    own, sizes = ranked(langs, ["lang"], "langs")
    depth = sizes.agg(F.max("depth")).first()[0] or 0
    top_tiers, roots = rolled_up(own.select("tree", "depth", "rank", "hash", "lang"), depth, ["lang"], "lang-blocks")
    root = F.lit((roots.first() or {"hash": None})["hash"])  # one row
    none = F.array().cast(_SIDES)
    start = roots.select("tree", F.lit(None).cast("string").alias("top"), none.alias("path"))
    start = proofs(top_tiers, start).select(F.col("node.lang").alias("tree"), F.col("node.hash").alias("top"), "path")
    rows = proofs(tiers, start).select("node.doc_id", F.col("node.hash").alias("leaf"), "node.forged", F.col("top").alias("subroot"), "path")
    siblings = F.array_join(F.flatten(F.transform("path", lambda p: F.array(p["left"], p["right"]))), "")
    folded = F.aggregate("path", F.coalesce("forged", "leaf"), lambda h, p: digest(F.concat(p["left"], h, p["right"])))
    rows = rows.select("doc_id", "leaf", "subroot", root.alias("root"), digest(siblings).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 7, top_levels: int = 3) -> str:
    """The manifest in SQL, a step for each level: up to 8 ** levels documents a language, 8 ** top_levels languages."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END))"
    codes = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {bit}), 4294967295)"
    parts = [
        f"hashed AS (SELECT doc_id, lang, sha256({head} || {field('text')}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {field(lower)}) END AS forged FROM documents)",
        """leafed AS (SELECT *, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
             count(*) OVER (PARTITION BY lang) AS size FROM hashed)""",
        "a0 AS (SELECT tree, rank, size, leaf AS hash FROM leafed)",
    ]

    def up(name: str, most: int) -> None:
        for k in range(most):
            parts.append(f"{name}_run{k} AS (SELECT tree, rank // 8 AS rank, size, list(hash ORDER BY rank) AS kids FROM {name}{k} GROUP BY ALL)")
            parts.append(f"{name}{k + 1} AS (SELECT tree, rank, size, CASE WHEN size > {8**k} THEN sha256(array_to_string(kids, '')) ELSE kids[1] END AS hash FROM {name}_run{k})")

    up("a", levels)
    parts.append(f"langs AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS size, hash, tree AS lang_tree FROM a{levels})")
    parts.append("b0 AS (SELECT tree, rank, size, hash FROM langs)")
    up("b", top_levels)
    parts.append(
        "f0 AS (SELECT doc_id, leafed.tree, leafed.rank, leafed.size, langs.rank AS top_rank, langs.size AS top_size, leaf, langs.hash AS subroot, coalesce(forged, leaf) AS folded, '' AS proof "
        "FROM leafed JOIN langs ON leafed.tree = langs.lang_tree)"
    )
    steps = [("a", k, "f.tree", "f.rank", "f.size") for k in range(levels)] + [("b", k, "''", "f.top_rank", "f.top_size") for k in range(top_levels)]
    for i, (name, k, tree, rank, size) in enumerate(steps):
        at = f"({rank} // {8**k}) % 8"
        left, right = f"array_to_string(list_slice(kids, 1, {at}), '')", f"array_to_string(list_slice(kids, {at} + 2, 8), '')"
        parts.append(
            f"f{i + 1} AS (SELECT f.* REPLACE (CASE WHEN {size} > {8**k} THEN sha256({left} || folded || {right}) ELSE folded END AS folded, "
            f"CASE WHEN {size} > {8**k} THEN proof || {left} || {right} ELSE proof END AS proof) FROM f{i} f JOIN {name}_run{k} r ON r.tree = {tree} AND r.rank = {rank} // {8 ** (k + 1)})"
        )
    root = f"(SELECT hash FROM b{top_levels})"
    last = f"SELECT doc_id, leaf, subroot, {root} AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = {root} AS verified FROM f{len(steps)}"
    return "WITH " + ",\n".join(parts) + "\n" + last


ORACLE = _oracle()
