"""Near-duplicates by SimHash and pivot distance tables, and by MinHash beyond its reach; links have a Jaccard similarity of 0.8 or more.

Texts with equal sets of five-word shingles are one node. Candidates come from near_dup's method first: fingerprints of
the texts, bit blocks, pivot distance tables; of each link the two texts meet in a bucket, and so do all texts of one
fingerprint. Similar sets lie up to 13 of 64 bits apart and more, where blocks selective enough to scale share nothing.
The others therefore come from MinHash: two sets of similarity s agree in a band of ROWS minima with s ** ROWS, so of
pairs at just 0.8 all but 0.06 % meet in one of BANDS. Buckets with the same members are one bucket. Every link is
verified on both whole sets.

A bucket emits a spanning forest of its links; buckets with very many nodes are cut into blocks that meet two by two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_dup
from .common import all_salts, salt, text_of, written
from .near_dup import SALTS, components, cut_cells, with_components

SHINGLE = 5
SEED = 42
BANDS = 14
ROWS = 4
#: A bucket with more nodes than this (and than a thousandth of all rows) is cut into blocks of about this size, which meet two by two.
HOT_BUCKET = 1024
# An odd factor and a mask per minimum, a factor per place in a band.
_DRAWN = np.random.Generator(np.random.PCG64(SEED))
_FACTORS = _DRAWN.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_MASKS = _DRAWN.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64)
_PLACES = _DRAWN.integers(0, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)
_SLICE = 200_000


def shingles_of(raw: bytes) -> np.ndarray:
    """The distinct shingles' hashes (32 bits), sorted; a text of fewer words is one shingle, one without words none."""
    words = raw.lower().split()
    if not words:
        return np.array([], dtype=np.uint32)
    text = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(text, SEED) >> 32], dtype=np.uint32)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    own = [digest(text[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :])]
    return np.unique((np.array(own, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A line of BANDS keys for each of the sets, none of them empty."""
    out = np.zeros((len(sets), BANDS), dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    ends = np.cumsum(sizes)
    k = 0
    while k < len(sets):
        begin = int(ends[k] - sizes[k])
        stop = max(k + 1, int(np.searchsorted(ends, begin + _SLICE, side="right")))
        flat = np.concatenate(sets[k:stop]).astype(np.uint64)
        starts = ends[k:stop] - sizes[k:stop] - begin
        for band in range(BANDS):
            key = np.full(stop - k, band + 1, dtype=np.uint64)
            for row in range(ROWS):
                n = band * ROWS + row
                least = np.minimum.reduceat((flat ^ _MASKS[n]) * _FACTORS[n], starts)
                key = (key ^ (least >> np.uint64(20))) * _PLACES[row]
                key ^= key >> np.uint64(29)
            out[k:stop, band] = key
        k = stop
    return out


def shingle_sets(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """doc_id, fp (64 bits of the set as a long), keys (bands), grams (the set, 4 bytes each), sim (the text's SimHash), and the columns in carry."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles_of(x.as_py()) for x in batch.column("raw")]
            grams = [s.tobytes() for s in sets]
            full = [k for k, s in enumerate(sets) if len(s)]
            keys = [[] for _ in sets]
            if full:
                for k, line in zip(full, band_keys([sets[k] for k in full]).view(np.int64)):
                    keys[k] = line
            fp = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype=np.uint64).view(np.int64)
            columns = {"doc_id": batch.column("doc_id"), "fp": pa.array(fp), "keys": pa.array(keys, pa.list_(pa.int64())), "grams": pa.array(grams, pa.binary()), "sim": batch.column("sim")}
            columns |= {f"carried_{i}": batch.column(f"carried_{i}") for i in range(len(carry))}
            yield pa.RecordBatch.from_pydict(columns)

    # the fingerprint's operator carries the text along, so both read it in one pass
    marked = near_dup.fingerprints(docs.select("doc_id", "text", text_of("text").cast("binary").alias("raw"), *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(carry)]), ["raw", *[f"own_{i}" for i in range(len(carry))]])
    rows = marked.select("doc_id", "raw", F.col("fp").alias("sim"), *[F.col(f"own_{i}").alias(f"carried_{i}") for i in range(len(carry))])
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(work, "doc_id long, fp long, keys array<long>, grams binary, sim long" + "".join(f", carried_{i} {kinds[f'carried_{i}']}" for i in range(len(carry))))
    return out.select("doc_id", "fp", "keys", "grams", "sim", *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)])


def alike(shared, a, b):
    """Whether sets of a and b members that share so many have a Jaccard similarity of 0.8 or more."""
    return 9 * shared >= 4 * (a + b)


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, walked outwards from one after another."""
    if len(sets) == 2:
        return [(0, 1)] if alike(len(np.intersect1d(*sets, assume_unique=True)), len(sets[0]), len(sets[1])) else []
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    ends = np.cumsum(sizes)
    members = [flat[e - s : e] for s, e in zip(sizes, ends)]
    left, starts = np.arange(len(sets)), ends - sizes
    flag = np.zeros(len(kinds), dtype=np.int32)
    alive = np.ones(len(sets), dtype=bool)
    found, queue = [], []
    for first in range(len(sets)):
        if not alive[first]:
            continue
        alive[first] = False
        queue.append(first)
        while queue and alive.any():
            x = queue.pop()
            if 2 * alive.sum() < len(left):
                left = np.flatnonzero(alive)
                flat = np.concatenate([members[k] for k in left])
                starts = np.cumsum(sizes[left]) - sizes[left]
            flag[members[x]] = 1
            shared = np.add.reduceat(flag[flat], starts)
            flag[members[x]] = 0
            hit = left[alive[left] & alike(shared, sizes[x], sizes[left])].tolist()
            found += [(x, k) for k in hit]
            alive[hit] = False
            queue += hit
        queue.clear()
    return found


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside runs of equal (key, cut), which come sorted; a run may go on in the next batch."""
    at, fps, sets = None, [], []

    def out(pairs):
        return pa.RecordBatch.from_pydict({"u": pa.array([max(p) for p in pairs], pa.int64()), "v": pa.array([min(p) for p in pairs], pa.int64())})

    def run():
        return [(fps[i], fps[j]) for i, j in forest(sets)] if len(sets) > 1 else []

    for batch in batches:
        pairs = []
        for key, cut, fp, grams in zip(*[batch.column(c).to_pylist() for c in ("key", "cut", "fp", "grams")]):
            if (key, cut) != at:
                pairs += run()
                at, fps, sets = (key, cut), [], []
            fps.append(fp)
            sets.append(np.frombuffer(grams, dtype=np.uint32))
        yield out(pairs)
    yield out(run())


def fingerprint_keys(marked: DataFrame) -> DataFrame:
    """fp, key: the buckets that near_dup's links give to the sets of marked (fp, sim, grams).

    All sets of a fingerprint share one, and of two linked fingerprints the least sets do: rows are linear in sets and
    links. Sets without shingles are left out.
    """
    sims = written(marked.where(F.length("grams") > 0).select("fp", "sim").distinct(), "sims")
    least = written(sims.groupBy("sim").agg(F.min("fp").alias("fp")), "least-sets")
    found = near_dup.links(least.select(F.col("sim").alias("fp")))
    ends = found.select(F.explode(F.array("u", "v")).alias("sim"), F.xxhash64(F.lit("link"), "u", "v").alias("key"))
    ends = written(ends, "fingerprint-links")
    # a fingerprint may have very many links: its least set returns over salted keys
    hot = [r["sim"] for r in ends.groupBy("sim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1000, ends.count() // 1000)).collect()]  # under a thousand
    spread = least.withColumn("salt", F.explode(all_salts(F.col("sim"), hot, SALTS)))
    linked = ends.withColumn("salt", salt(F.col("sim"), hot, F.col("key"), SALTS)).join(spread, ["sim", "salt"]).select("fp", "key")
    return sims.select("fp", F.xxhash64(F.lit("same"), "sim").alias("key")).union(linked)


def links(marked: DataFrame) -> DataFrame:
    """u, v: links between the sets of marked (fp, keys, grams, sim), enough to connect all that are linked in a bucket."""
    keyed = written(marked.select("fp", F.explode("keys").alias("key")).union(fingerprint_keys(marked)).distinct(), "bands")
    signature = F.sum(F.xxhash64("fp").cast("decimal(20,0)"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), signature.alias("who")).where("n > 1")
    buckets = written(buckets.groupBy("n", "who").agg(F.min("key").alias("key")).select("key", "n"), "buckets")
    bound = max(HOT_BUCKET, keyed.count() // 1000)
    sizes = {r["key"]: r["n"] for r in buckets.where(F.col("n") > bound).collect()}
    hot = list(sizes)
    spread = buckets.withColumn("salt", F.explode(all_salts(F.col("key"), hot, SALTS))).select("key", "salt")
    members = keyed.withColumn("salt", salt(F.col("key"), hot, F.col("fp"), SALTS)).join(spread, ["key", "salt"]).select("key", "fp")
    members = members.withColumn("cut", F.explode(cut_cells(F.col("key"), F.col("fp"), sizes, HOT_BUCKET)))
    members = written(members, "members")
    sets = marked.groupBy("fp").agg(F.first("grams").alias("grams"))
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.join(sets, "fp").select("key", "cut", "fp", "grams").repartition(parts, "key", "cut").sortWithinPartitions("key", "cut")
    return dealt.mapInArrow(_linked, "u long, v long").distinct()


def group(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Every row with its component of similar texts: doc_id, component_id (its smallest doc_id), best, and carry.

    As near_dup.group: null ids are larger than all others, one row of a component is best. Texts without words are alike.
    """
    names = [f"carried_{i}" for i in range(len(carry))]
    marked = written(shingle_sets(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for n, c in zip(names, carry)]), names), "shingles")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    out = with_components(marked.drop("keys", "grams", "sim"), nodes, components(links(marked)))
    return out.select("doc_id", "component_id", "best", *[F.col(n).alias(c) for n, c in zip(names, carry)])


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of similar texts; same columns.

    Null texts count as empty; texts without words are alike and one of them stays. Of a component the smallest id stays,
    of rows that repeat it one. An empty table gives no rows.
    """
    columns = docs.columns
    wide = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(columns)])
    rows = group(wide, carry=[f"in_{i}" for i in range(len(columns))])
    return rows.where("best").select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(columns)])
