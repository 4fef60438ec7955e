"""LM scoring by context-tree weighting over binary-decomposed bytes.

A text is its lower-cased words joined by spaces and one end. Each byte is coded as eight binary decisions; each
decision node (a prefix of the byte's bits) has its own context tree over the DEPTH bytes before. A node of that tree
estimates its bit from counts by Krichevsky-Trofimov; the tree mixes the estimates of all depths with the weights that
context-tree weighting gives: P_w = (P_e + prod P_w(children)) / 2. A context without training counts estimates one half,
as do all below it.

How it runs at scale. Documents are dealt once to blocks of about BLOCK_BYTES. A block sends each distinct
(context, byte) and each distinct word once, with its training count, to the shard that owns it, packed in one binary
per block and shard; shards own whole subtrees (all contexts that share their last two bytes). A shard merges the
counts, weighs its subtrees and answers every block with one number per item; blocks then add up their texts' numbers.
So the model is never in one place and nothing grows with the corpus on the driver: it sees only the trees' upper two
levels (256 x 255 nodes, a proven bound) and two totals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

DEPTH = 5
BLOCK_BYTES = 5_000_000
FOLDS, HELD_OUT = 7, 2
_END = b"\n"
_TABLE = 1 << 14
#: Keys whose trees are weighed at a time: whole subtrees, so a larger one is a slice of its own.
_SLICE = 1_000_000

_LOG_RISING = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE) + 0.5))])  # ln G(n + 1/2) - ln G(1/2)
_LOG_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE) + 1.0))])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for large x."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""

    def rising(n):
        return np.where(n <= _TABLE, _LOG_RISING[np.minimum(n, _TABLE)], _log_gamma(np.maximum(n, 1) + 0.5) - 0.5 * np.log(np.pi))

    n = zeros + ones
    factorial = np.where(n <= _TABLE, _LOG_FACTORIAL[np.minimum(n, _TABLE)], _log_gamma(np.maximum(n, 1) + 1.0))
    return rising(zeros) + rising(ones) - factorial


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Its estimate that the next bit is one."""
    return (ones + 0.5) / (zeros + ones + 1.0)


class Level:
    """Nodes of one depth that decide one bit: for each (context, byte) entry its node; counts of each node."""

    def __init__(self, entries: np.ndarray, counts: np.ndarray, bit: int):
        prefix = entries >> np.uint64(8 - bit)
        new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
        self.first = np.flatnonzero(new)
        self.node = np.cumsum(new) - 1
        ones = counts * ((entries >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
        self.ones = np.add.reduceat(ones, self.first)
        self.zeros = np.add.reduceat(counts, self.first) - self.ones
        self.own = kt_log(self.zeros, self.ones)


class Subtrees:
    """The trees below the contexts of a shard, from the counts of its (context, byte) keys, sorted.

    Keys have the last byte of the context first, then those before, then the byte itself.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH):
        self.depth = depth
        self.entries, self.counts, self.up = {depth: keys}, {depth: counts}, {}
        for d in range(depth - 1, 1, -1):
            below = self.entries[d + 1]
            shorter = (below >> np.uint64(16) << np.uint64(8)) | (below & np.uint64(255))
            self.entries[d], self.up[d + 1] = np.unique(shorter, return_inverse=True)
            self.counts[d] = np.bincount(self.up[d + 1], weights=self.counts[d + 1], minlength=len(self.entries[d])).astype(np.int64)

    def weigh(self, bit: int) -> tuple[dict[int, Level], dict[int, np.ndarray], dict[int, np.ndarray], np.ndarray]:
        """Bottom up: the levels, each node's parent, its weight, and ln P_w at depth 2."""
        levels = {d: Level(self.entries[d], self.counts[d], bit) for d in range(self.depth, 1, -1)}
        parent, weight = {}, {self.depth: np.ones(len(levels[self.depth].first))}
        total = levels[self.depth].own
        for d in range(self.depth - 1, 1, -1):
            here, below = levels[d], levels[d + 1]
            parent[d + 1] = here.node[self.up[d + 1][below.first]]
            children = np.bincount(parent[d + 1], weights=total, minlength=len(here.first))
            total = np.log(0.5) + np.logaddexp(here.own, children)
            weight[d] = np.exp(np.log(0.5) + here.own - total)
        return levels, parent, weight, total

    def upper(self, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the level above needs: its nodes (last byte and bit prefix), ln P_w of children summed, zeros, ones."""
        levels, _, _, total = self.weigh(bit)
        node = self._above(bit, levels[2])
        found, at = np.unique(node, return_inverse=True)
        add = lambda x: np.bincount(at, weights=x, minlength=len(found))
        return found, add(total), add(levels[2].zeros), add(levels[2].ones)

    def _above(self, bit: int, level: Level) -> np.ndarray:
        entry = self.entries[2][level.first]
        prefix = (np.uint64(1) << np.uint64(bit)) | ((entry & np.uint64(255)) >> np.uint64(8 - bit))
        return ((entry >> np.uint64(16)) << np.uint64(8) | prefix).astype(np.int64)

    def log10(self, top: Top) -> np.ndarray:
        """log10 of the mixed probability of each key's byte after its context."""
        out = np.zeros(len(self.entries[self.depth]))
        keys = self.entries[self.depth]
        for bit in range(8):
            levels, parent, weight, _ = self.weigh(bit)
            node = self._above(bit, levels[2])
            mixed, rest = top.mixed[node], top.rest[node]
            for d in range(2, self.depth + 1):
                here = levels[d]
                if d > 2:
                    mixed, rest = mixed[parent[d]], rest[parent[d]]
                mixed, rest = mixed + rest * weight[d] * kt(here.zeros, here.ones), rest * (1 - weight[d])
            p = mixed[levels[self.depth].node]
            is_one = (keys >> np.uint64(7 - bit)) & np.uint64(1) == 1
            out += np.log10(np.where(is_one, p, 1 - p))
        return out


class Top:
    """Depths 0 and 1 of all trees: mixture so far, and the weight left for below."""

    def __init__(self, nodes: np.ndarray, children: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        full = [np.zeros(1 << 16) for _ in range(3)]
        for a, x in zip(full, (children, zeros, ones)):
            a[nodes] = x
        below, z1, o1 = full
        own = kt_log(z1.astype(np.int64), o1.astype(np.int64))
        total = np.log(0.5) + np.logaddexp(own, below)
        w1 = np.exp(np.log(0.5) + own - total)
        by_byte = lambda x: x.reshape(256, 256).sum(axis=0)
        z0, o0 = by_byte(z1), by_byte(o1)
        own0 = kt_log(z0.astype(np.int64), o0.astype(np.int64))
        w0 = np.exp(own0 - np.logaddexp(own0, by_byte(total)))
        one0, one1 = np.tile(kt(z0, o0), 256), kt(z1, o1)
        w0 = np.tile(w0, 256)
        self.mixed = w0 * one0 + (1 - w0) * w1 * one1
        self.rest = (1 - w0) * (1 - w1)


def keys_of(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) keys of all bytes of normalised texts, and the text each belongs to; ends precede a text."""
    pad = _END * depth
    data = np.frombuffer(b"".join([x for t in texts for x in (pad, t)] + [bytes(8)]), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + depth) - sizes - depth
    scored = np.ones(len(data) - 8, dtype=bool)
    for k in range(depth):
        scored[starts + k] = False
    scored = scored[depth:]
    # eight bytes from each place on as one number, the first lowest: its low bytes are the context of the byte after them
    ahead = np.ndarray(len(scored), dtype="<u8", buffer=data, strides=(1,))
    keys = ahead[scored]
    keys &= np.uint64((1 << 8 * depth) - 1)
    keys <<= np.uint64(8)
    keys |= data[depth : len(data) - 8][scored]
    return keys, np.repeat(np.arange(len(texts), dtype=np.uint16), sizes)


def _normal(raw: bytes | None) -> tuple[bytes, list[bytes]]:
    words = (raw or b"").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    return b" ".join(words) + _END, words


def _parts(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in parts of under 65536, so that a text's number fits 16 bits."""
    for k in range(0, len(texts), 1 << 16):
        yield k, texts[k : k + (1 << 16)]


def _grouped(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts under 65536: the distinct keys, where their runs start, and the text of each run's members."""
    keys, own = keys_of(texts, depth)
    if depth <= 5:  # a key of six bytes and its text's number fit one word, which sorts fastest
        keys <<= np.uint64(16)
        keys |= own
        keys.sort()
        own = keys.astype(np.uint16)
        keys >>= np.uint64(16)
    else:
        order = np.argsort(keys)
        own, keys = own[order], keys[order]
        del order
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], starts, own


def _trees(keys: np.ndarray, counts: np.ndarray, depth: int) -> Iterator[Subtrees]:
    """The subtrees of sorted keys, about _SLICE keys at a time; keys of a subtree (two bytes of context) stay together."""
    two = keys >> np.uint64(8 * (depth - 1))
    first = np.flatnonzero(np.concatenate([[True], two[1:] != two[:-1]])) if len(keys) else np.array([], dtype=np.int64)
    start = 0
    while start < len(keys):
        k = int(np.searchsorted(first, start + _SLICE))
        stop = len(keys) if k == len(first) else max(int(first[k - 1]), int(first[np.searchsorted(first, start, side="right")]) if first[k - 1] <= start else 0)
        yield Subtrees(keys[start:stop], counts[start:stop], depth)
        start = stop


def _packed(values: np.ndarray, kind: type = np.int64) -> bytes:
    """Ascending numbers as their steps: mostly zero bytes, which Spark's shuffle compresses."""
    return np.diff(values.astype(np.int64), prepend=0).astype(kind).tobytes()


def _unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype=kind), dtype=np.int64)


def _shard_of_keys(keys: np.ndarray, depth: int, shards: int) -> np.ndarray:
    """By the last two bytes of the context, mixed."""
    two = keys >> np.uint64(8 * (depth - 1))
    return ((two * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shards


def _word_keys(words) -> tuple[np.ndarray, list[bytes]]:
    """64-bit hashes of distinct words, sorted, and the words in that order."""
    words = list(words)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    order = np.argsort(hashes, kind="stable")
    return hashes[order], [words[k] for k in order]


def _split(keys: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the keys of each shard, in order of the keys."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]])) if len(keys) else []
    for part in np.split(order, cuts[1:]) if len(keys) else []:
        yield int(shard[part[0]]), part


_SENT = "shard long, block long, kind string, keys binary, counts binary"
_KEPT = "shard long, block long, kind string, a binary, b binary"


def _block_sends(depth: int, shards: int):
    def work(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        train = np.array(table.column("train").to_pylist(), dtype=bool)
        normal = [_normal(x.as_py()) for x in table.column("raw")]
        counted, every = Counter(), set()
        for (_, words), learns in zip(normal, train):
            every.update(words)
            if learns:
                counted.update(words)
        found = []
        for k, texts in _parts([t for t, _ in normal]):
            keys, starts, own = _grouped(texts, depth)
            found.append((keys, np.add.reduceat(train[k:][own].astype(np.int64), starts)))
        keys, counts = found[0] if len(found) == 1 else _merged(found)
        rows = [(s, block, "gram", _packed(keys[p]), counts[p].astype(np.int32).tobytes()) for s, p in _split(keys, _shard_of_keys(keys, depth, shards))]
        hashes, words = _word_keys(every)
        counts = np.array([counted[w] for w in words], dtype=np.int64)
        rows += [(s, block, "word", _packed(hashes[p].view(np.int64)), counts[p].astype(np.int32).tobytes()) for s, p in _split(hashes, (hashes >> np.uint64(20)).astype(np.int64) % shards)]
        return _rows(rows, _SENT)

    return work


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with counts from several such."""
    keys, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([f[1] for f in found]), minlength=len(keys)).astype(np.int64)


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _longs(x) -> np.ndarray:
    return np.frombuffer(x.as_py(), dtype=np.int64)


def _shard_merges(depth: int):
    """Per shard and kind: merged counts; where each block's items are in them; for words the answers at once."""

    def work(table: pa.Table) -> pa.Table:
        shard, kind = table.column("shard")[0].as_py(), table.column("kind")[0].as_py()
        blocks = table.column("block").to_pylist()
        keys = [_unpacked(x.as_py()).view(np.uint64) for x in table.column("keys")]
        merged, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([np.frombuffer(x.as_py(), dtype=np.int32) for x in table.column("counts")]), minlength=len(merged)).astype(np.int64)
        parts = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
        if kind == "word":
            value = np.log10(counts + 1.0)
            rows = [(shard, b, "word", value[p].tobytes(), None) for b, p in zip(blocks, parts)]
            rows.append((shard, None, "total", np.array([counts.sum(), (counts > 0).sum()]).tobytes(), None))
        else:
            rows = [(shard, b, "at", _packed(p, np.int32), None) for b, p in zip(blocks, parts)]
            rows.append((shard, None, "model", _packed(merged), counts.tobytes()))
            for trees in _trees(merged, counts, depth):
                for bit in range(8):
                    nodes, *sums = trees.upper(bit)
                    rows.append((shard, None, "upper", nodes.tobytes(), np.stack(sums).tobytes()))
        return _rows(rows, _KEPT)

    return work


def _upper_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column("a"), batch.column("b")):
            sums = np.frombuffer(b.as_py(), dtype=np.float64).reshape(3, -1)
            yield pa.RecordBatch.from_pydict({"node": pa.array(_longs(a)), "children": pa.array(sums[0]), "zeros": pa.array(sums[1]), "ones": pa.array(sums[2])})


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = np.array([_longs(a) for a in batch.column("a")], dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_pydict({"n": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})


def _shard_answers(depth: int, top: Top):
    def work(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        rows = list(zip(table.column("block"), table.column("kind").to_pylist(), table.column("a"), table.column("b")))
        model = next((a, b) for _, kind, a, b in rows if kind == "model")
        value = np.concatenate([t.log10(top).astype(np.float32) for t in _trees(_unpacked(model[0].as_py()).view(np.uint64), _longs(model[1]), depth)])
        answers = [(shard, block.as_py(), "gram", value[_unpacked(a.as_py(), np.int32)].tobytes(), None) for block, kind, a, _ in rows if kind == "at"]
        return _rows(answers, _KEPT)

    return work


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, log_counts double, score double"


def _block_scores(depth: int, shards: int, n_ends: int):
    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if docs.num_rows == 0:
            return _rows([], _SCORED)
        normal = [_normal(x.as_py()) for x in docs.column("raw")]
        mine = {(kind, shard): a for shard, kind, a in zip(answers.column("shard").to_pylist(), answers.column("kind").to_pylist(), answers.column("a"))}
        hashes, words = _word_keys(set().union(*(w for _, w in normal)))
        value = np.zeros(len(words))
        for s, p in _split(hashes, (hashes >> np.uint64(20)).astype(np.int64) % shards):
            value[p] = np.frombuffer(mine["word", s].as_py(), dtype=np.float64)
        logs = dict(zip(words, value.tolist()))
        end = float(np.log10(n_ends + 1.0))
        parts = [(k, *_grouped(texts, depth)) for k, texts in _parts([t for t, _ in normal])]
        keys = parts[0][1] if len(parts) == 1 else np.unique(np.concatenate([p[1] for p in parts]))
        value = np.zeros(len(keys))
        for s, p in _split(keys, _shard_of_keys(keys, depth, shards)):
            value[p] = np.frombuffer(mine["gram", s].as_py(), dtype=np.float32)
        score = np.zeros(len(normal))
        for k, own_keys, starts, own in parts:
            sums = np.bincount(own, weights=np.repeat(value[np.searchsorted(keys, own_keys)], np.diff(np.append(starts, len(own)))))
            score[k : k + len(sums)] += sums
        rows = []
        for (text, w), doc_id, train, total in zip(normal, docs.column("doc_id").to_pylist(), docs.column("train").to_pylist(), score.tolist()):
            found = [logs[x] for x in w]
            known = sum(x > 0 for x in found) + (n_ends > 0)
            rows.append((doc_id, not train, len(w) + 1, known, len(text), sum(found) + end, total))
        return _rows(rows, _SCORED)

    return work


def score(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The log10 probability of every whole text, under counts of all rows that are not held out.

    Returns doc_id, held_out (crc32 of the id mod 7 is 2), n_tokens, n_known, train_tokens, base_score (add-one
    unigrams over words), score (the model's) and code_length (bits per byte of the normalised text). A null text is
    empty: one end token. A null id is never held out. Repeated rows are counted and scored each. Without training
    rows all estimates are uniform. Words are told apart by 64-bit hashes. depth is 2 to 7: a key fits 64 bits.
    """
    raw = text_of("text").cast("binary")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    sized = docs.agg(F.sum(F.octet_length(text_of("text"))), F.sum(F.when(F.coalesce(fold != HELD_OUT, F.lit(True)), 1).otherwise(0))).first()
    blocks = max(1, -(-int(sized[0] or 0) // block_bytes))
    n_ends = int(sized[1] or 0)
    shards = blocks // 2 + 1
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        raw.alias("raw"),
        F.coalesce(fold != HELD_OUT, F.lit(True)).alias("train"),
        F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(blocks)).cast("long").alias("block"),
    )
    dealt = rows.repartition(blocks, "block")
    sent = dealt.groupBy("block").applyInArrow(_block_sends(depth, shards), _SENT)
    kept = written(sent.groupBy("shard", "kind").applyInArrow(_shard_merges(depth), _KEPT), "ctw-model")
    upper = kept.where("kind = 'upper'").select("a", "b").mapInArrow(_upper_rows, "node long, children double, zeros double, ones double")
    upper = upper.groupBy("node").agg(F.sum("children"), F.sum("zeros"), F.sum("ones")).orderBy("node").toPandas()
    top = Top(upper["node"].to_numpy(dtype=np.int64), *[upper.iloc[:, k].to_numpy(dtype=np.float64) for k in (1, 2, 3)])
    total = kept.where("kind = 'total'").select("a").mapInArrow(_totals, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    n = (total[0] or 0) + n_ends
    v = (total[1] or 0) + (n_ends > 0)
    grams = kept.where("kind in ('at', 'model')").groupBy("shard").applyInArrow(_shard_answers(depth, top), _KEPT)
    answers = grams.union(kept.where("kind = 'word'")).select("shard", "block", "kind", "a")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_block_scores(depth, shards, n_ends), _SCORED)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1.0)))).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(float(np.log2(10.0))) / F.col("n_bytes")).alias("code_length"),
    )
