"""SimHash near-duplicates, verified through pivot distance tables.

Each text's fingerprint is the bitwise majority of its shingles' hashes. Equal fingerprints are one node, so copies
cost nothing further. Fingerprints are cut into bit blocks; two within 4 bits agree in at least all blocks but four, so
each node goes to a bucket for every choice of so many blocks, and all links lie inside buckets. More nodes are cut into
more blocks, which makes keys longer and keeps buckets small. In a bucket, a table of distances to reference
fingerprints is computed once per node; a pair whose coordinates differ by more than 4 anywhere cannot link and is
discarded; the survivors are verified on the full 64 bits.

A bucket emits no more than a spanning forest of its links (a group of near copies gives a line per member, not all
pairs); buckets with very many nodes are cut into blocks that meet two by two, over many tasks. Links become
components by alternating large-star and small-star rounds over Spark tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import all_salts, hot_values, salt, text_of, written

BITS = 4
SHINGLE = 4
SEED = 42
#: Blocks by number of nodes: 6 give keys of 21 bits, 7 of 27, 8 of 32. Links are the same with each.
BLOCKS = ((1 << 23, 6), (1 << 29, 7), (1 << 63, 8))
SALTS = 64
#: A bucket with more nodes than this (and than a thousandth of all) is cut into blocks of about this size, which meet two by two.
HOT_BUCKET = 4096
#: Reference fingerprints: fixed values, from a rule (multiples of the golden ratio's 64 bits).
PIVOTS = np.array([(0x9E3779B97F4A7C15 * k) & (2**64 - 1) for k in range(1, 17)], dtype=np.uint64)
_SLICE = 100_000


def fingerprint_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint per text: the bits set in over half of its hashes; counts has how many hashes each text has."""
    out = np.zeros(len(counts), dtype=np.uint64)
    ends = np.cumsum(counts)
    k = 0
    while k < len(counts):
        begin = int(ends[k] - counts[k])
        stop = max(k + 1, int(np.searchsorted(ends, begin + _SLICE, side="right")))
        votes = np.zeros((stop - k, 64), dtype=np.int64)
        if stop == k + 1:  # a text that may be longer than a slice
            for a in range(begin, int(ends[k]), _SLICE):
                part = hashes[a : min(a + _SLICE, int(ends[k]))]
                votes[0] += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        else:
            own = counts[k:stop]
            full = np.flatnonzero(own)
            if len(full):
                bits = np.unpackbits(hashes[begin : int(ends[stop - 1])].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                starts = (ends[k:stop] - own)[full] - begin
                votes[full] = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        major = votes * 2 > counts[k:stop, None]
        out[k:stop] = np.packbits(major, axis=1).view(">u8").ravel().astype(np.uint64)
        k = stop
    return out


def fingerprints(docs: DataFrame, carry: list[str] = (), shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (64 bits as a long) and the columns in carry, for every row's whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            hashes, counts = [], []
            found = []
            for x in batch.column("raw"):
                words = x.as_py().lower().split()  # bytes: A-Z only, and the six ASCII spaces
                n = len(words)
                text = b" ".join(words)
                if n <= shingle:
                    own = [digest(text, SEED)] if n else []
                else:
                    ends = list(accumulate([len(w) + 1 for w in words]))
                    own = [digest(text[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :])]
                hashes.append(np.array(own, dtype=np.uint64))
                counts.append(len(own))
                if sum(counts) > 20 * _SLICE:
                    found.append(fingerprint_of(np.concatenate(hashes), np.array(counts, dtype=np.int64)))
                    hashes, counts = [], []
            if counts:
                found.append(fingerprint_of(np.concatenate(hashes), np.array(counts, dtype=np.int64)))
            fp = np.concatenate(found).view(np.int64) if found else np.array([], dtype=np.int64)
            columns = {"doc_id": batch.column("doc_id"), "fp": pa.array(fp)}
            columns |= {f"carried_{i}": batch.column(f"carried_{i}") for i in range(len(carry))}
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of("text").cast("binary").alias("raw"),
        *[F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(carry)],
    )
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(work, "doc_id long, fp long" + "".join(f", carried_{i} {kinds[f'carried_{i}']}" for i in range(len(carry))))
    return out.select("doc_id", "fp", *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)])


def _bucket_keys(blocks: int, bits: int) -> Column:
    """The bucket numbers of a node: for each choice of blocks that a link must share, its place and the blocks' bits."""
    widths = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    at = [0, *accumulate(widths)]
    block = lambda k: F.shiftrightunsigned("fp", at[k]).bitwiseAND(F.lit((1 << widths[k]) - 1))

    def key(n: int, chosen: tuple[int, ...]) -> Column:
        out = F.lit(n).cast("long")
        for k in chosen:
            out = F.shiftleft(out, widths[k]) + block(k)
        return out

    return F.array(*[key(n, chosen) for n, chosen in enumerate(combinations(range(blocks), blocks - bits))])


def cut_cells(key: Column, member: Column, sizes: dict[int, int], room: int) -> Column:
    """The cells to which a member of a bucket goes: in a hot one, cell (c, d) for its own block c and each other d."""
    if not sizes:
        return F.array(F.lit(0).cast("long"))
    many = F.coalesce(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(-(-n // room)))])[key], F.lit(1)).cast("long")
    own = F.pmod(F.xxhash64(member), many)
    return F.transform(F.sequence(F.lit(0).cast("long"), many - 1), lambda d: F.least(own, d) * many + F.greatest(own, d))


def distances(fps: np.ndarray) -> np.ndarray:
    """The pivot table: distances to all references, a line per fingerprint."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def near(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> np.ndarray:
    """Which of the pairs (i, j) link: coordinates first, the survivors on all bits."""
    keep = np.flatnonzero(np.abs(table[i] - table[j]).max(axis=1) <= bits)
    return keep[np.bitwise_count(fps[i[keep]] ^ fps[j[keep]]) <= bits]


def forest(fps: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among one bucket's nodes, walked outwards from one node after another."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    left = np.arange(len(fps))
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            # left stays in order of the first coordinate
            lo, hi = np.searchsorted(table[left, 0], [table[x, 0] - bits, table[x, 0] + bits + 1])
            some = left[lo:hi]
            hit = near(fps, table, np.full(len(some), x), some, bits)
            if len(hit):
                a += [x] * len(hit)
                b += some[hit].tolist()
                queue += some[hit].tolist()
                left = np.delete(left, lo + hit)
    return order[np.array(a, dtype=np.int64)], order[np.array(b, dtype=np.int64)]


def links_of(keys: np.ndarray, fps: np.ndarray, bits: int = BITS, small: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys (sorted): all of small runs, a spanning forest of each larger one."""
    starts = np.flatnonzero(np.concatenate([[True], np.any(keys[1:] != keys[:-1], axis=1)])) if len(keys) else np.array([], dtype=np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    some = np.repeat(np.where(sizes <= small, sizes, 0), sizes)  # the size of each row's run, 0 for the large
    place = np.arange(len(keys)) - np.repeat(starts, sizes)
    table = distances(fps)
    for step in range(1, small):
        i = np.flatnonzero(place + step < some)
        if not len(i):
            break
        hit = i[near(fps, table, i, i + step, bits)]
        a.append(fps[hit])
        b.append(fps[hit + step])
    for k in np.flatnonzero(sizes > small):
        part = slice(starts[k], starts[k] + sizes[k])
        i, j = forest(fps[part], table[part], bits)
        a.append(fps[part][i])
        b.append(fps[part][j])
    none = np.array([], dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _linked(bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys, fps):
            a, b = links_of(keys, fps, bits)
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_pydict({"u": pa.array(np.maximum(a, b)), "v": pa.array(np.minimum(a, b))})

        held: list[tuple[np.ndarray, np.ndarray]] = []  # parts of the last run, which may go on in the next batch
        for batch in batches:  # sorted by key
            keys = np.stack([batch.column("key").to_numpy(), batch.column("cut").to_numpy()], axis=1)
            fps = batch.column("fp").to_numpy().view(np.uint64)
            if not len(keys):
                continue
            if held and np.any(keys[0] != held[-1][0][-1]):
                yield out(*map(np.concatenate, zip(*held)))
                held = []
            ends = np.flatnonzero(np.any(keys != keys[-1], axis=1))
            end = int(ends[-1]) + 1 if len(ends) else 0
            if end:
                held.append((keys[:end], fps[:end]))
                yield out(*map(np.concatenate, zip(*held)))
                held = []
            held.append((keys[end:], fps[end:]))
        if held:
            yield out(*map(np.concatenate, zip(*held)))

    return work


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """u, v: links between the fingerprints of nodes (column fp, distinct), enough to connect all that are linked."""
    count = nodes.count()
    blocks = next(b for most, b in BLOCKS if count <= most)
    keyed = nodes.select("fp", F.explode(_bucket_keys(blocks, bits)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HOT_BUCKET, count // 1000))
    hot = {r["key"]: r["n"] for r in sizes.collect()}  # under a thousand for each choice of blocks
    keyed = keyed.withColumn("cut", F.explode(cut_cells(F.col("key"), F.col("fp"), hot, HOT_BUCKET)))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, "key", "cut").sortWithinPartitions("key", "cut")
    return dealt.mapInArrow(_linked(bits), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for the nodes of edges (u > v), root itself left out.

    Large star and small star rounds, each written to shared storage, until nothing changes. A node with very many links
    meets its least neighbour over salted keys.
    """
    edges = written(edges, "links")
    seen = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = _meet(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = written(large, "links")
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = _meet(large, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def _meet(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with the m of their u; least has the number n of each u's edges."""
    total = least.agg(F.sum("n")).first()[0] or 0
    hot = [r["u"] for r in least.where(F.col("n") > max(1000, total // 1000)).select("u").collect()]  # under a thousand
    spread = least.select("u", "m", F.explode(all_salts(F.col("u"), hot, SALTS)).alias("salt"))
    return edges.withColumn("salt", salt(F.col("u"), hot, F.col("v"), SALTS)).join(spread, ["u", "salt"])


def with_components(marked: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Every row of marked (doc_id, fp, ...) with component_id and best, from nodes (fp, least_id) and their components."""
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "fp"))
    ids = rooted.groupBy("root").agg(least.alias("least")).select("root", F.col("least.least_id").alias("component_id"), F.col("least.fp").alias("best_fp"))
    # a component may hold very many fingerprints: its id returns over salted keys
    hot = hot_values(rooted, "root")
    spread = ids.withColumn("salt", F.explode(all_salts(F.col("root"), hot, SALTS)))
    named = rooted.withColumn("salt", salt(F.col("root"), hot, F.col("fp"), SALTS)).join(spread, ["root", "salt"]).select("fp", "component_id", "best_fp")
    hot = hot_values(marked.select("fp"), "fp")
    spread = named.withColumn("salt", F.explode(all_salts(F.col("fp"), hot, SALTS)))
    out = marked.withColumn("salt", salt(F.col("fp"), hot, F.coalesce("doc_id", F.lit(0)), SALTS)).join(spread, ["fp", "salt"])
    # rows that repeat id and fingerprint share a salted group, so this window needs no shuffle of its own
    first = F.row_number().over(Window.partitionBy("fp", "salt", "doc_id").orderBy(F.lit(0)))
    best = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("best_fp")) & (first == 1)
    return out.withColumn("best", best)


def group(docs: DataFrame, carry: list[str] = (), bits: int = BITS) -> DataFrame:
    """Every row with its component of near-duplicates.

    Returns doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component), best (whether the row
    is the one of its component to keep: the smallest id) and the columns in carry. Texts without words have
    fingerprint zero and link like any other. Null ids are larger than all others; a component of null ids only has a
    null component_id. Of rows that repeat the smallest id one is best. An empty table gives no rows.
    """
    names = [f"carried_{i}" for i in range(len(carry))]
    marked = written(fingerprints(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for n, c in zip(names, carry)]), names), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    out = with_components(marked, nodes, components(links(nodes, bits)))
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "best",
        *[F.col(n).alias(c) for n, c in zip(names, carry)],
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near-duplicates; same columns."""
    columns = docs.columns
    wide = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(columns)])
    rows = group(wide, carry=[f"in_{i}" for i in range(len(columns))])
    return rows.where("best").select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(columns)])
