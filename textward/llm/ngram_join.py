"""N-gram Jaccard join by grouped prefixes: documents whose sets of four-word shingles are similar, found exactly.

Texts with equal sets are one node. Shingles are ordered from rarest to commonest; two sets of similarity 0.85 share a
shingle among each one's first 15 % in that order (its prefix). Shingles that no other set has come first and can't be
shared, so a node with too many of them has no partner and goes no further.

1. Postings: shingles meet their like in buckets, packed into byte columns (6 bytes each and 2 for the text's number in
   its block). Only those found twice return, with their count, to their block, which knows its texts' names; only nodes
   of which enough has returned go on. Very common ones are counted before, per task block, and never enter a bucket.
2. Groups: nodes of one size and prefix are one group; groups meet in the list of each prefix shingle and size window
   (two of similar size share a window). Lists with the same members are one list.
3. Representatives: every group of a list is verified against the list's representative, and every member of a group
   against its group's. That is linear in the lists, and links most of what is linked.
4. The rest: lists whose members are not one component yet, all lists of a representative as one. Jaccard distance is a
   metric, so what lies too near the representative cannot reach a stray; the others are compared by walks through the
   list, long lists in cells.

Each link is verified on the whole sets. Common and unshared shingles change the order, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_salts, hot_values, salt, text_of, written
from .near_dup import SALTS, components, with_components

SHINGLE = 4
SEED = 42
PERCENT = 85
#: Shingles of a block, of which one task packs two at once, and of a bucket, which one task counts at once.
BLOCK = 1 << 19
BUCKET = 1 << 21
#: Added to the counts of common shingles, which are shared by any text's own reckoning.
ALWAYS = 1 << 31
#: Common shingles: more than this often, and than one in COMMON_SHARE of all shingles: so at most COMMON_SHARE of them.
COMMON = 4096
COMMON_SHARE = 1 << 20
#: How often a block must hold a shingle to report it as perhaps common.
REPORTED = 8
#: A list of more nodes than this is compared in cells of about this size.
HOT_LIST = 1024
#: Texts that a task remembers to have met, and words that a worker does.
SEEN = 1_000_000
WORDS = 500_000
#: The factors of a shingle's words: fixed values, from a rule (powers of the golden ratio's 64 bits, of which no two sums agree).
PLACES = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(SHINGLE)], dtype=np.uint64)


class _Words(dict):
    """Hashes of words, remembered by the worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        found = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= 64:
            self[word] = found
        return found


_words = _Words()


def shingles_of(raw: bytes) -> tuple[int, np.ndarray]:
    """How many distinct shingles a text has, and their classes (48 bits), sorted; a short text is one, without words none.

    A shingle's hash sums its words' hashes, each times the factor of its place.
    """
    words = raw.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0, np.array([], dtype=np.uint64)
    own = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    length = min(SHINGLE, len(words))
    kinds = own[: len(own) - length + 1] * PLACES[0]
    for k in range(1, length):
        kinds += own[k : len(own) - length + 1 + k] * PLACES[k]
    kinds = np.unique(kinds)
    classes = kinds >> np.uint64(16)
    return len(kinds), classes if np.all(classes[1:] != classes[:-1]) else np.unique(classes)


def set_id(n: int, classes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(classes.tobytes(), SEED + n) if n else 0


def need(n):
    """How many shingles a set of n shares at least with any similar one."""
    return (PERCENT * n + 99) // 100


def _blocks(batches: Iterator[pa.RecordBatch], block: int, remembered: int) -> Iterator[tuple]:
    """(ids, set ids, numbers of shingles, None) of each batch; and (None, set ids, numbers, sets) of those the task has not met before, in blocks."""
    seen: set[int] = set()
    fps, sizes, sets, held = [], [], [], 0
    for batch in batches:
        own, counts = [], []
        for raw in batch.column("raw"):
            n, classes = shingles_of(raw.as_py())
            fp = set_id(n, classes)
            own.append(fp)
            counts.append(n)
            if n and fp not in seen:
                seen.add(fp)
                fps.append(fp)
                sizes.append(n)
                sets.append(classes)
                held += n
            if held >= block or len(fps) >= 1 << 16:
                yield None, fps, sizes, sets
                fps, sizes, sets, held = [], [], [], 0
        if len(seen) > remembered:
            seen.clear()
        yield batch.column("doc_id"), own, counts, None
    if fps:
        yield None, fps, sizes, sets


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").cast("binary").alias("raw"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, fp (its set's id), n of every row; and rows with n = -1 whose fp is a shingle that a block holds `often` times."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, fps, sizes, sets in _blocks(batches, BLOCK, SEEN):
            if ids is not None:
                columns = {"doc_id": ids, "fp": _signed(fps), "n": pa.array(sizes, pa.int64()), "often": pa.nulls(len(fps), pa.int64())}
            else:
                kinds, counts = np.unique(np.concatenate(sets), return_counts=True)
                kinds, counts = kinds[counts >= REPORTED], counts[counts >= REPORTED]
                columns = {"doc_id": pa.nulls(len(kinds), pa.int64()), "fp": _signed(kinds), "n": pa.array(np.full(len(kinds), -1)), "often": pa.array(counts, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    return _raw(docs).mapInArrow(work, "doc_id long, fp long, n long, often long")


def common_shingles(rows: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes found very often by blocks, and how often: at most COMMON_SHARE of them, so 16 MB."""
    counts = rows.where("n = -1").groupBy("fp").agg(F.sum("often").alias("often")).where(F.col("often") > max(COMMON, total // COMMON_SHARE))
    found = counts.sort("fp").toArrow()
    return found.column("fp").to_numpy().view(np.uint64), found.column("often").to_numpy()


def _planes(values: np.ndarray, width: int) -> bytes:
    """The values' lowest bytes, place by place: bytes that agree lie side by side."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T.tobytes()


def _values(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    wide[:, 8 - width :] = np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T
    return wide.view(">u8").ravel().astype(np.uint64)


def postings(docs: DataFrame, bits: int, common: np.ndarray) -> DataFrame:
    """Packed shingles: bucket, block, tokens (6 bytes each) and owners (2 bytes each: which of the block's texts), as byte planes.

    What a shingle takes is the same for any number of buckets: texts are named once a block, by fps and sizes, in its row
    of bucket -1, where its common shingles are, which need no counting.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for ids, fps, sizes, sets in _blocks(batches, 2 * BLOCK, SEEN):
            if ids is not None:
                continue
            tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            buckets = (tokens >> np.uint64(48 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), dtype=np.int64)
            if len(common):
                buckets[common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens] = -1
            order = np.argsort(buckets, kind="stable")
            found = np.unique(np.append(buckets, -1))  # the row of bucket -1 is there without common shingles too
            ends = np.searchsorted(buckets[order], found, side="right")
            spans = [order[a:b] for a, b in zip([0, *ends], ends)]
            names = [np.array(fps, dtype=np.uint64).tobytes()], [np.array(sizes, dtype=np.int32).tobytes()]
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(found), "block": pa.array(np.full(len(found), block)),
                "tokens": pa.array([_planes(tokens[x], 6) for x in spans], pa.binary()), "owners": pa.array([_planes(owners[x], 2) for x in spans], pa.binary()),
            } | {c: pa.array(own + [None] * (len(found) - 1), pa.binary()) for c, own in zip(("fps", "sizes"), names)})
            block += 1

    return _raw(docs).mapInArrow(work, "bucket long, block long, tokens binary, owners binary, fps binary, sizes binary")


def _counted(common: np.ndarray, often: np.ndarray):
    """Of a bucket, the shingles that more than one text has posted, with their counts, for each block; common ones have theirs."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        own = [_values(x, 6) for x in table.column("tokens").to_pylist()]
        tokens = np.concatenate(own)
        if key[0].as_py() < 0:
            counts = ALWAYS + np.minimum(often[np.searchsorted(common, tokens)], ALWAYS - 1)
            some = np.ones(len(tokens), dtype=bool)
        else:
            _, at, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            counts = counts[at]
            some = counts > 1
        ends = np.cumsum([len(x) for x in own])
        rows = []
        for a, b, block, owners, fps, sizes in zip([0, *ends], ends, *[table.column(c).to_pylist() for c in ("block", "owners", "fps", "sizes")]):
            hit = some[a:b]
            if fps is not None or hit.any():
                rows.append((block, _planes(tokens[a:b][hit], 6), _planes(_values(owners, 2)[hit], 2), _planes(counts[a:b][hit], 4), fps, sizes))
        columns = zip(*rows) if rows else [[]] * 6
        return pa.table({c: pa.array(x, pa.int64() if c == "block" else pa.binary()) for c, x in zip(("block", "tokens", "owners", "counts", "fps", "sizes"), columns)})

    return work


def _returned(table: pa.Table) -> pa.Table:
    """fp, n, tokens, counts of those texts of a block of which so many shingles returned that they may have a partner."""
    columns = {c: table.column(c).to_pylist() for c in ("tokens", "owners", "counts", "fps", "sizes")}
    fps = np.frombuffer(next(x for x in columns["fps"] if x is not None), dtype=np.int64)
    sizes = np.frombuffer(next(x for x in columns["sizes"] if x is not None), dtype=np.int32).astype(np.int64)
    tokens, owners, counts = [np.concatenate([_values(x, width) for x in columns[c]]) for c, width in (("tokens", 6), ("owners", 2), ("counts", 4))]
    owners = owners.astype(np.int64)
    order = np.lexsort((tokens, owners))
    tokens, counts = tokens[order], counts[order]
    ends = np.cumsum(np.bincount(owners, minlength=len(fps)))
    starts = np.append(0, ends[:-1])
    kept = np.flatnonzero(ends - starts >= need(sizes))
    return pa.table({
        "fp": pa.array(fps[kept]), "n": pa.array(sizes[kept]),
        "tokens": pa.array([_planes(tokens[starts[k] : ends[k]], 6) for k in kept], pa.binary()), "counts": pa.array([_planes(counts[starts[k] : ends[k]], 4) for k in kept], pa.binary()),
    })


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp, n, prefix (its shared part, rarest first), tokens (all shared, sorted) of the sets that share enough to have a partner.

    A set that several blocks hold has posted its shingles so often: others share what is counted more often.
    """
    for batch in batches:
        found = []
        for fp, n, copies, own, often in zip(*[batch.column(c).to_pylist() for c in ("fp", "n", "copies", "tokens", "counts")]):
            tokens, counts = _values(own, 6), _values(often, 4)
            shared = counts > copies
            tokens, counts = tokens[shared], counts[shared]
            if len(tokens) >= need(n):
                first = n - need(n) + 1 - (n - len(tokens))
                rarest = tokens[np.lexsort((tokens, counts))[:first]]
                found.append((fp, n, rarest.view(np.int64), tokens.tobytes()))
        kinds = {"fp": pa.int64(), "n": pa.int64(), "prefix": pa.list_(pa.int64()), "tokens": pa.binary()}
        yield pa.RecordBatch.from_pydict({c: pa.array(x, kinds[c]) for c, x in zip(kinds, zip(*found) if found else [[]] * 4)})


def candidates(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The sets (fp, n, prefix, tokens) that share enough shingles with others to have a partner."""
    total = rows.where("n > 0").agg(F.sum("n")).first()[0] or 0
    common, often = common_shingles(rows, total)
    bits = max(0, (total // BUCKET).bit_length())
    # a block's row of common shingles and names needs no counting and is a group of its own
    packed = postings(docs, bits, common).withColumn("part", F.when(F.col("bucket") < 0, F.col("block")).otherwise(F.lit(0).cast("long")))
    found = packed.groupBy("bucket", "part").applyInArrow(_counted(common, often), "block long, tokens binary, owners binary, counts binary, fps binary, sizes binary")
    found = found.groupBy("block").applyInArrow(_returned, "fp long, n long, tokens binary, counts binary")
    whole = found.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "tokens", "counts")])
    return whole.mapInArrow(_candidates, "fp long, n long, prefix array<long>, tokens binary")


def _met(rows: DataFrame, ones: DataFrame, key: str) -> DataFrame:
    """rows joined with ones (a row for each key) on key, of which one may hold very many of the rows."""
    rows = rows.withColumn("_hot_key", F.col(key).cast("string"))
    hot = hot_values(rows, "_hot_key")
    spread = ones.withColumn("_salt", F.explode(all_salts(F.col(key).cast("string"), hot, SALTS)))
    rows = rows.withColumn("_salt", salt(F.col("_hot_key"), hot, F.xxhash64(*[c for c in rows.columns if c != key]), SALTS))
    return rows.join(spread, [key, "_salt"]).drop("_hot_key", "_salt")


def grouped(sets: DataFrame) -> DataFrame:
    """fp, n, prefix, g of each set: g is the least fp of the group of sets with its size and prefix."""
    rows = sets.select("fp", "n", "prefix", F.xxhash64("n", "prefix").alias("kind"))
    groups = rows.groupBy("kind", "n", "prefix").agg(F.min("fp").alias("g"))
    same = groups.select("kind", F.struct("n", "prefix").alias("own"), "g")
    hot = hot_values(rows.select(F.col("kind").cast("string").alias("kind")), "kind")
    same = same.withColumn("salt", F.explode(all_salts(F.col("kind").cast("string"), hot, SALTS)))
    rows = rows.withColumn("salt", salt(F.col("kind").cast("string"), hot, F.col("fp"), SALTS))
    return rows.join(same, ["kind", "salt"]).where(F.col("own") == F.struct("n", "prefix")).select("fp", "n", "prefix", "g")


def listed(members: DataFrame) -> DataFrame:
    """list, g, rep: the groups in the list of each prefix shingle and size window, and the list's representative.

    Similar sizes lie in one window or in neighbours, so each group is in two. Lists of a single set are left out; of
    lists with the same groups one is kept.
    """
    window = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT)) + 1e-9).cast("long")
    groups = members.groupBy("g").agg(F.count(F.lit(1)).alias("sets"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    rows = groups.select("g", "sets", F.explode("prefix").alias("token"), F.array(window, window - 1).alias("windows"))
    rows = rows.select("g", "sets", "token", F.explode("windows").alias("window")).select("g", "sets", F.xxhash64("token", "window").alias("list"))
    rows = written(rows, "lists")
    who = F.sum(F.xxhash64("g").cast("decimal(20,0)"))
    own = rows.groupBy("list").agg(F.sum("sets").alias("sets"), F.count(F.lit(1)).alias("groups"), who.alias("who"), F.min("g").alias("rep")).where("sets > 1")
    own = own.groupBy("sets", "groups", "who").agg(F.min_by(F.struct("list", "rep"), "list").alias("own")).select("own.list", "own.rep")
    return _met(rows.select("list", "g"), own, "list")


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column("u_tokens")]
        other = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column("v_tokens")]
        shared = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(own, other)]
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("u", "v", "u_n", "v_n")} | {"shared": pa.array(shared, pa.int64())})


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, distance, linked of pairs, by their whole sets (fp, n, tokens); v may be a representative of very many."""
    ones = sets.select(F.col("fp").alias("u"), F.col("n").alias("u_n"), F.col("tokens").alias("u_tokens"))
    twos = sets.select(F.col("fp").alias("v"), F.col("n").alias("v_n"), F.col("tokens").alias("v_tokens"))
    both = _met(pairs, twos, "v").join(ones, "u")
    out = both.select("u", "v", "u_n", "v_n", "u_tokens", "v_tokens").mapInArrow(_overlaps, "u long, v long, u_n long, v_n long, shared long")
    union = F.col("u_n") + F.col("v_n") - F.col("shared")
    return out.select("u", "v", (1 - F.col("shared") / union).alias("distance"), (100 * F.col("shared") >= PERCENT * union).alias("linked"))


def forest(sets: list[np.ndarray], sizes: np.ndarray) -> list[tuple[int, int]]:
    """Links among sets, enough to connect all that are linked: walked outwards from one set after another."""
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    lengths = np.array([len(s) for s in sets])
    ends = np.cumsum(lengths)
    order = np.argsort(flat, kind="stable")
    owners = np.repeat(np.arange(len(sets)), lengths)[order]
    bounds = np.searchsorted(flat[order], np.arange(len(kinds) + 1))
    alive, found = np.ones(len(sets), dtype=bool), []
    for first in range(len(sets)):
        queue = [first] if alive[first] else []
        alive[first] = False
        while queue and alive.any():
            x = queue.pop()
            holders = [owners[bounds[k] : bounds[k + 1]] for k in flat[ends[x] - lengths[x] : ends[x]]]
            shared = np.bincount(np.concatenate(holders), minlength=len(sets))
            hit = np.flatnonzero(alive & (100 * shared >= PERCENT * (sizes[x] + sizes - shared))).tolist()
            found += [(x, k) for k in hit]
            alive[hit] = False
            queue += hit
    return found


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside runs of equal (rep, cell), which come sorted; a run may go on in the next batch."""
    at, fps, sizes, sets = None, [], [], []

    def run() -> pa.RecordBatch:
        pairs = [(fps[i], fps[j]) for i, j in forest(sets, np.array(sizes))] if len(sets) > 1 else []
        return pa.RecordBatch.from_pydict({"u": pa.array([max(p) for p in pairs], pa.int64()), "v": pa.array([min(p) for p in pairs], pa.int64())})

    for batch in batches:
        for key, cell, fp, n, tokens in zip(*[batch.column(c).to_pylist() for c in ("rep", "cell", "fp", "n", "tokens")]):
            if (key, cell) != at:
                yield run()
                at, fps, sizes, sets = (key, cell), [], [], []
            fps.append(fp)
            sizes.append(n)
            sets.append(np.frombuffer(tokens, dtype=np.uint64))
    yield run()


def unfinished(entries: DataFrame) -> DataFrame:
    """rep, fp, many: of the representatives met by more than one component, who may still link across, and in how many parts to cut them.

    entries: rep, fp, n, root, distance (to rep). A set in the representative's component that is nearer to it than every
    stray by more than a link's length cannot link to a stray.
    """
    own = entries.groupBy("rep").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.when(F.col("fp") == F.col("rep"), F.col("root"))).alias("home")).where("low != high")
    rows = written(_met(entries, own.select("rep", "home"), "rep"), "open-lists")
    nearest = rows.where("root != home").groupBy("rep").agg(F.min("distance").alias("nearest"))
    reach = F.col("nearest") - (100 - PERCENT) / 100 - 1e-9
    rows = written(_met(rows, nearest, "rep").where((F.col("root") != F.col("home")) | (F.col("distance") >= reach)).select("rep", "fp", "n"), "strays")
    sizes = rows.groupBy("rep").agg(F.greatest(F.ceil(F.count(F.lit(1)) / HOT_LIST), F.ceil(F.sum("n") / BLOCK)).alias("many"))
    return _met(rows.select("rep", "fp"), sizes, "rep")


def links(sets: DataFrame) -> DataFrame:
    """u, v (u > v): links between sets (fp, n, prefix, tokens), enough to connect all that are similar."""
    members = written(grouped(sets), "members")
    lists = written(listed(members), "lists-kept")
    pairs = lists.select("g", "rep").where("g != rep").distinct()
    pairs = _met(members.select(F.col("fp").alias("u"), "g"), pairs.groupBy("g").agg(F.collect_set("rep").alias("reps")), "g").select("u", F.explode("reps").alias("v"))
    pairs = pairs.union(members.where("fp != g").select(F.col("fp").alias("u"), F.col("g").alias("v"))).where("u != v").distinct()
    near = written(verified(pairs, sets), "near")
    ends = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    roots = written(components(ends(near.where("linked"))), "roots")
    # all that share a list share its representative, and so one entry each
    rooted = members.select("fp", "n").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", F.coalesce("root", "fp").alias("root"))
    entries = near.select(F.col("v").alias("rep"), F.col("u").alias("fp"), "distance").join(rooted, "fp")
    own = near.select(F.col("v").alias("fp")).distinct().join(rooted, "fp").select("fp", F.col("fp").alias("rep"), F.lit(0.0).alias("distance"), "n", "root")
    rest = unfinished(entries.unionByName(own))
    part = F.pmod(F.xxhash64("fp"), "many")
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("many") - 1), lambda k: F.least(part, k) * F.col("many") + F.greatest(part, k))
    rest = rest.select("rep", "fp", F.explode(cells).alias("cell")).join(sets.select("fp", "n", "tokens"), "fp")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rest.repartition(parts, "rep", "cell").sortWithinPartitions("rep", "cell").mapInArrow(_linked, "u long, v long")
    return roots.select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).union(found).distinct()


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: how many shingles its set has, and the least doc_id it is linked to over any steps.

    Documents link when 100 * shared >= 85 * all shingles of both. Texts of fewer than four words are one shingle; null
    texts and texts without words have none and link with nothing: their component_id is their own doc_id. Null ids come
    after all others; a component of null ids only has a null component_id. Repeated rows and equal sets are linked.
    Texts are read whole, other columns are not read. An empty table gives no rows.
    """
    rows = written(sized(docs), "sized")
    marked = rows.where("n > 0").select("doc_id", "fp", "n")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    sets = written(candidates(docs, rows), "candidates")
    out = with_components(marked, nodes, components(links(sets))).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
