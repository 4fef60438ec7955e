"""Character n-grams counted in Arrow batches: a word is cut once for a task, and what a text's words give is added up by numpy.

Texts come as a column made, a list of the texts whose n-grams have a vocabulary of their own each. Only sums, weights or
scores leave a task, never a row per text and n-gram; what a task holds is bounded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words and terms that a task holds at most.
WORDS, TERMS = 200_000, 400_000
_NONE = np.array([], dtype=np.int64)
#: Tasks for each core, at most, where every task sends a line per term.
TASKS = 3
#: Rows packed at a time, and rows summed at a time, whose numbers stay in a core's cache.
SLICE, PASS = 500, 100
#: Tasks that send the driver an array of a number per term, at most.
LINES = 64


def _few(rows: DataFrame) -> DataFrame:
    """rows in a few tasks for each core: what the tasks send is then bounded by cores and terms, however many rows there are."""
    return rows.coalesce(TASKS * rows.sparkSession.sparkContext.defaultParallelism)


def cut(word: str, least: int, most: int) -> list[str]:
    """The n-grams of a word padded by one space, as functions.text.gram_counts; words split at the same white space as str.split."""
    padded = f" {word} "
    if len(padded) < least:
        return [padded]
    return [padded[i : i + n] for n in range(least, most + 1) for i in range(len(padded) - n + 1)]


def packs(least: int, most: int) -> bool:
    """Whether n-grams fit 64 bits, 16 for each character's number, and no padded word is shorter than the least size."""
    return 2 <= least <= 3 and most <= 4


class Letters:
    """Numbers of characters, from 1 as they are met (or only those of some terms), and n-grams packed by them."""

    def __init__(self, terms: list[str] | None = None):
        self.number, self.point, self.open = np.zeros(0x110000, dtype=np.uint16), [0], terms is None
        self._meet(np.unique(_points("".join(terms or []) + " ")))

    def _meet(self, points: np.ndarray) -> None:
        self.number[points] = np.arange(len(self.point), len(self.point) + len(points))
        self.point += points.tolist()

    def full(self) -> bool:
        return len(self.point) > 30_000

    def packed(self, text: str, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys, ascending, and counts of a text's n-grams whose characters have numbers."""
        words = text.split()
        points = _points(f" {' '.join(words)} " if words else "")
        ids = self.number[points]
        if self.open and not ids.all():
            self._meet(np.unique(points[ids == 0]))
            ids = self.number[points]
        inside, known, ids = points != 32, ids != 0, ids.astype(np.uint64)
        found = []
        for n in range(least, most + 1):
            size = len(ids) - n + 1
            if size < 1:
                break
            key, good = ids[:size].copy(), known[:size].copy()
            for j in range(1, n):
                key |= ids[j : j + size] << np.uint64(16 * j)
                good &= known[j : j + size]
                if j < n - 1:
                    good &= inside[j : j + size]
            found.append(key[good])
        return np.unique(np.concatenate(found), return_counts=True) if found else (_NONE.astype(np.uint64), _NONE)

    def key(self, term: str) -> int:
        return sum(int(self.number[ord(ch)]) << 16 * j for j, ch in enumerate(term))

    def terms(self, keys: np.ndarray) -> list[str]:
        point = np.array(self.point, dtype=np.uint32)
        wide = np.stack([(keys >> np.uint64(16 * j)) & np.uint64(0xFFFF) for j in range(4)], axis=1).astype(np.int64)
        return ["".join(map(chr, row[:n])) for row, n in zip(point[wide].tolist(), (wide > 0).sum(axis=1).tolist())]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Counts:
    """Numbers of the n-grams of words: those in known, or all, numbered as they are met."""

    def __init__(self, sizes: tuple[int, int], known: dict[str, int] | None = None):
        self.sizes, self.open, self.terms, self.words = sizes, known is None, {} if known is None else known, {}
        self.letters = None
        if known and packs(*sizes):
            self.letters = Letters(list(known))
            if self.letters.full():
                self.letters = None
        if self.letters:
            keys = np.array([self.letters.key(g) for g in known], dtype=np.uint64)
            order = np.argsort(keys)
            self.keys, self.places = keys[order], np.fromiter(known.values(), np.int64, len(known))[order]

    def _of(self, word: str) -> list[int]:
        grams = cut(word, *self.sizes)
        if self.open:
            return [self.terms.setdefault(g, len(self.terms)) for g in grams]
        return [k for k in map(self.terms.get, grams) if k is not None]

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of the n-grams of a text, each once; ascending where all n-grams are numbered."""
        if self.letters:
            keys, tf = self.letters.packed(text, *self.sizes)
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            return self.places[at[hit]], tf[hit]
        words = Counter(text.split())
        if len(self.words) > WORDS:
            self.words.clear()
        own = []
        for w in words:
            ids = self.words.get(w)
            if ids is None:
                ids = self._of(w)
                if len(w) < 64:
                    self.words[w] = ids
            own.append(ids)
        if not own:
            return _NONE, _NONE
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        at = np.fromiter(chain.from_iterable(own), np.int32, int(sizes.sum()))
        times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes)
        order = np.argsort(at, kind="stable")
        at, times = at[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else _NONE
        return (at[first], np.add.reduceat(times, first)) if len(at) else (_NONE, _NONE)


def totals(texts: DataFrame, names: list[str], sizes: tuple[int, int], by: Column | None = None) -> DataFrame:
    """by, part, term, total, df of texts (made): how often each term occurs and in how many of the texts."""
    least, most = sizes

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each group and part: keys, ascending, their totals and dfs, and what came of other keys, which room counts
        letters, held, room = Letters(), {}, 0

        def merged():
            for own in held.values():
                if own[3]:
                    keys, total = (np.concatenate([x, *more]) for x, more in zip(own, zip(*own[3])))
                    df = np.concatenate([own[2], np.ones(len(keys) - len(own[2]), dtype=np.int64)])
                    order = np.argsort(keys)
                    keys, total, df = keys[order], total[order], df[order]
                    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    own[:] = keys[first], np.add.reduceat(total, first), np.add.reduceat(df, first), []

        def out():
            merged()
            for (group, k), (keys, total, df, _) in held.items():
                yield pa.RecordBatch.from_pydict({
                    "by": pa.array(np.full(len(keys), group, dtype=np.int32)), "part": pa.array([names[k]] * len(keys), pa.string()), "term": pa.array(letters.terms(keys), pa.string()),
                    "total": pa.array(total), "df": pa.array(df),
                })
            held.clear()

        for batch in batches:
            for group, made in zip(batch.column("by").to_pylist(), batch.column("made")):
                for k, text in enumerate(made.as_py()):
                    keys, tf = letters.packed(text, least, most)
                    if not len(keys):
                        continue
                    own = held.setdefault((group, k), [_NONE.astype(np.uint64), _NONE, _NONE, []])
                    at = np.searchsorted(own[0], keys)
                    hit = at < len(own[0])
                    hit[hit] = own[0][at[hit]] == keys[hit]
                    own[1][at[hit]] += tf[hit]
                    own[2][at[hit]] += 1
                    if not hit.all():
                        own[3].append((keys[~hit], tf[~hit]))
                        room += len(own[3][-1][0])
                if room > TERMS // 8 and room > (size := sum(len(own[0]) for own in held.values())):
                    merged()
                    room, size = 0, sum(len(own[0]) for own in held.values())
                    if size > 2 * TERMS:
                        yield from out()
                if letters.full():
                    yield from out()
                    letters, room = Letters(), 0
        yield from out()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        cutters = [Counts((least, most)) for _ in names]

        def out():
            for (group, k), (total, df) in held.items():
                at = np.flatnonzero(df)
                terms = list(cutters[k].terms)  # in order of their numbers
                yield pa.RecordBatch.from_pydict({
                    "by": pa.array(np.full(len(at), group, dtype=np.int32)), "part": pa.array([names[k]] * len(at), pa.string()), "term": pa.array([terms[i] for i in at], pa.string()),
                    "total": pa.array(total[at]), "df": pa.array(df[at]),
                })
            held.clear()
            for c in cutters:
                c.terms.clear()
                c.words.clear()

        for batch in batches:
            for group, made in zip(batch.column("by").to_pylist(), batch.column("made")):
                for k, text in enumerate(made.as_py()):
                    at, tf = cutters[k](text)
                    if not len(at):
                        continue
                    if (group, k) not in held:
                        held[group, k] = [np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)]
                    own = held[group, k]
                    if at[-1] >= len(own[0]):
                        own[:] = [np.concatenate([x, np.zeros(max(len(x), int(at[-1]) + 1 - len(x)), dtype=np.int64)]) for x in own]
                    own[0][at] += tf
                    own[1][at] += 1
                if sum(len(c.terms) for c in cutters) > TERMS:
                    yield from out()
        yield from out()

    rows = _few(texts.select((F.lit(0) if by is None else by).cast("int").alias("by"), "made"))
    found = rows.mapInArrow(packed if packs(least, most) else work, "by int, part string, term string, total long, df long")
    return found.groupBy("by", "part", "term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


class Vocabularies:
    """One or several models' terms: their numbers by part and a line per model of idf, 0 where a model has no such term."""

    def __init__(self, found: DataFrame, models: int, names: list[str]):
        """found: model, part, term, idf and maybe coefficient; so many rows as models have terms, at most `size` each."""
        rows = found.toArrow()
        self.names, self.known, self._sent = names, [{} for _ in names], None
        self._cutters: list[Counts] | None = None
        place = {name: k for k, name in enumerate(names)}
        at = []
        self.keys: list[tuple[int, str]] = []
        for part, term in zip(rows.column("part").to_pylist(), rows.column("term").to_pylist()):
            k = place[part]
            if term not in self.known[k]:
                self.known[k][term] = len(self.keys)
                self.keys.append((k, term))
            at.append(self.known[k][term])
        model, at = rows.column("model").to_numpy(), np.array(at, dtype=np.int64)
        self.kind = np.uint16 if len(self.keys) <= 1 << 16 else np.uint32  # holds a term's number
        self.idf, self.coefficient = np.zeros((models, len(self.keys))), np.zeros((models, len(self.keys)))
        self.idf[model, at] = rows.column("idf").to_numpy()
        if "coefficient" in rows.column_names:
            self.coefficient[model, at] = rows.column("coefficient").to_numpy()

    def sent(self, spark: SparkSession):
        """The broadcast of this, made once."""
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(self)
        return self._sent

    def __getstate__(self):
        return self.__dict__ | {"_sent": None, "_cutters": None}

    def cutters(self, sizes: tuple[int, int]) -> list[Counts]:
        """One per part; a worker keeps them, and the words they know, for its next tasks."""
        if self._cutters is None or self._cutters[0].sizes != sizes:
            self._cutters = [Counts(sizes, known) for known in self.known]
        return self._cutters


def _weights(tf: np.ndarray, idf: np.ndarray, sublinear: bool, norm: str) -> np.ndarray:
    """The weights of one text's terms, of length 1; where none is known, all 0."""
    w = _raw(tf, sublinear) * idf
    length = _length(w, norm)
    return w / length if length > 0 else w


def _raw(tf: np.ndarray, sublinear: bool) -> np.ndarray:
    return 1.0 + np.log(tf) if sublinear else tf.astype(np.float64)


def _length(w: np.ndarray, norm: str) -> float:
    return float(np.sqrt((w * w).sum()) if norm == "l2" else np.abs(w).sum())


def class_sums(texts: DataFrame, found: Vocabularies, kinds: list[tuple[int, bool, str]], sizes: tuple[int, int]) -> DataFrame:
    """model, part, term, w1, w0: unit weights of the terms summed over the texts of either label (made, fold, n1, n0, n).

    kinds: for each model the fold that it leaves out, and whether counts are sublinear and by which norm. A text of n
    rows, n1 of label 1 and n0 of label 0, is n copies that share its length.
    """
    sent = found.sent(texts.sparkSession)
    least, most = sizes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        cutters = own.cutters((least, most))
        sums = np.zeros((2, *own.idf.shape))
        for batch in batches:
            for made, fold, n1, n0, n in zip(batch.column("made"), *[batch.column(c).to_pylist() for c in ("fold", "n1", "n0", "n")]):
                for cutter, text in zip(cutters, made.as_py()):
                    at, tf = cutter(text)
                    if not len(at):
                        continue
                    for m, (held, sublinear, norm) in enumerate(kinds):
                        if fold != held:
                            w = _weights(tf, own.idf[m, at], sublinear, norm) / (np.sqrt(n) if norm == "l2" else n)
                            if n1:
                                sums[1, m, at] += n1 * w
                            if n0:
                                sums[0, m, at] += n0 * w
        for m in range(len(kinds)):
            at = np.flatnonzero(own.idf[m] != 0)
            parts, terms = zip(*[own.keys[i] for i in at]) if len(at) else ((), ())
            yield pa.RecordBatch.from_pydict({
                "model": pa.array(np.full(len(at), m, dtype=np.int32)), "part": pa.array([own.names[k] for k in parts], pa.string()), "term": pa.array(list(terms), pa.string()),
                "w1": pa.array(sums[1, m, at]), "w0": pa.array(sums[0, m, at]),
            })

    rows = texts.select("made", F.col("fold").cast("int").alias("fold"), *[F.col(c).cast("long").alias(c) for c in ("n1", "n0", "n")])
    made = _few(rows).mapInArrow(work, "model int, part string, term string, w1 double, w0 double")
    return made.groupBy("model", "part", "term").agg(F.sum("w1").alias("w1"), F.sum("w0").alias("w0"))


def dots(texts: DataFrame, found: Vocabularies, kinds: list[tuple[int, bool, str]], sizes: tuple[int, int], keep: list[str], blank: bool = False) -> DataFrame:
    """keep, model, dot: each text's unit weights times the coefficients, by each model whose fold it is in (made, fold).

    Texts without words give no row, or with blank a null dot.
    """
    sent = found.sent(texts.sparkSession)
    least, most = sizes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        cutters = own.cutters((least, most))
        for batch in batches:
            rows, model, dot = [], [], []
            for r, (made, fold) in enumerate(zip(batch.column("made"), batch.column("fold").to_pylist())):
                asked, texts = [m for m, kind in enumerate(kinds) if kind[0] == fold], made.as_py()
                if not asked or not any(texts):
                    if blank:
                        rows += [r] * len(asked)
                        model += asked
                        dot += [None] * len(asked)
                    continue
                counts = [cutter(text) for cutter, text in zip(cutters, texts)]
                for m in asked:
                    rows.append(r)
                    model.append(m)
                    dot.append(sum(float((_weights(tf, own.idf[m, at], *kinds[m][1:]) * own.coefficient[m, at]).sum()) for at, tf in counts if len(at)))
            taken = pa.array(rows, pa.int64())
            columns = {f"kept_{i}": batch.column(f"kept_{i}").take(taken) for i in range(len(keep))}
            yield pa.RecordBatch.from_pydict(columns | {"model": pa.array(model, pa.int32()), "dot": pa.array(dot, pa.float64())})

    rows = texts.select(*[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)], "made", F.col("fold").cast("int").alias("fold"))
    types = dict(rows.dtypes)
    out = rows.mapInArrow(work, "".join(f"kept_{i} {types[f'kept_{i}']}, " for i in range(len(keep))) + "model int, dot double")
    return out.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], "model", "dot")


def vectors(texts: DataFrame, found: Vocabularies, sublinear: bool, norm: str, sizes: tuple[int, int], keep: list[str], more: list[Column] = ()) -> DataFrame:
    """keep, idx, w: each text's numbers of terms, ascending, and their weights, of unit length in each part (made); the numbers after all terms are those of more."""
    sent = found.sent(texts.sparkSession)
    (least, most), extra = sizes, len(more)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        cutters = known.cutters((least, most))
        last = np.arange(len(known.keys), len(known.keys) + extra)
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                tails = np.stack([batch.column(f"more_{i}").to_numpy(zero_copy_only=False) for i in range(extra)], axis=1) if extra else np.zeros((batch.num_rows, 0))
                ids, ws = [], []
                for made, tail in zip(batch.column("made"), tails):
                    counts = [cutter(text) for cutter, text in zip(cutters, made.as_py())]
                    at = np.concatenate([at for at, _ in counts])
                    w = np.concatenate([_weights(tf, known.idf[0, own], sublinear, norm) for own, tf in counts])
                    order = np.argsort(at)
                    ids += [at[order], last]
                    ws += [w[order], tail]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)[::2]
                columns = {f"kept_{i}": batch.column(f"kept_{i}") for i in range(len(keep))}
                flat = {"idx": np.concatenate([_NONE, *ids]).astype(np.int32), "w": np.concatenate([np.zeros(0), *ws])}
                yield pa.RecordBatch.from_pydict(columns | {c: pa.ListArray.from_arrays(ends, pa.array(x)) for c, x in flat.items()})

    rows = texts.select(*[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)], "made", *[c.cast("double").alias(f"more_{i}") for i, c in enumerate(more)])
    types = dict(rows.dtypes)
    out = rows.mapInArrow(work, "".join(f"kept_{i} {types[f'kept_{i}']}, " for i in range(len(keep))) + "idx array<int>, w array<double>")
    return out.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], "idx", "w")


def packed(texts: DataFrame, found: Vocabularies, norm: str, sublinear: bool, sizes: tuple[int, int], keep: list[str], more: list[Column] = ()) -> DataFrame:
    """keep, and of each part k of a text (made): idx_k and tf_k, its terms' numbers and counts as bytes, and len_k, the length of their weights; more_i are those of more.

    A quarter of the bytes of vectors: a count and its idf give the weight again. Counts of 255 and more are 255 in tf_k and stand in over_k.
    """
    sent = found.sent(texts.sparkSession)
    (least, most), extra, kind = sizes, len(more), found.kind

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        cutters = known.cutters((least, most))
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE):
                batch = whole.slice(a, SLICE)
                columns = {f"kept_{i}": batch.column(f"kept_{i}") for i in range(len(keep))}
                counts = [[cutter(text) for cutter, text in zip(cutters, made.as_py())] for made in batch.column("made")]
                for k in range(len(cutters)):
                    own = [c[k] for c in counts]
                    columns[f"idx_{k}"] = pa.array([at.astype(kind).tobytes() for at, _ in own], pa.binary())
                    columns[f"tf_{k}"] = pa.array([np.minimum(tf, 255).astype(np.uint8).tobytes() for _, tf in own], pa.binary())
                    columns[f"over_{k}"] = pa.array([tf[tf >= 255].astype(np.uint32).tobytes() for _, tf in own], pa.binary())
                    columns[f"len_{k}"] = pa.array([_length(_raw(tf, sublinear) * known.idf[0, at], norm) or 1.0 for at, tf in own], pa.float64())
                yield pa.RecordBatch.from_pydict(columns | {f"more_{i}": batch.column(f"more_{i}") for i in range(extra)})

    rows = texts.select(*[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)], "made", *[c.cast("double").alias(f"more_{i}") for i, c in enumerate(more)])
    types = dict(rows.dtypes)
    fields = [f"kept_{i} {types[f'kept_{i}']}" for i in range(len(keep))] + [f"idx_{k} binary, tf_{k} binary, over_{k} binary, len_{k} double" for k in range(len(found.names))] + [f"more_{i} double" for i in range(extra)]
    out = rows.mapInArrow(work, ", ".join(fields))
    return out.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], *out.columns[len(keep):])


class Rows:
    """Packed rows (label, 0 or 1) to be passed over again and again, with what sums over their weights need."""

    def __init__(self, rows: DataFrame, found: Vocabularies, sublinear: bool, extra: int, weights: tuple[float, float]):
        self.rows, self.kind, self.parts, self.sublinear, self.extra, self.weights = rows, found.kind, len(found.names), sublinear, extra, np.array(weights)
        self.idf = np.concatenate([found.idf[0], np.ones(extra)])

    def _sums(self, of, width: int) -> np.ndarray:
        """The sum over slices of of(label, parts, more), arrays of width numbers; parts: numbers and raw weights of the terms, and the rows' numbers of terms and lengths."""
        kind, parts, sublinear, extra = self.kind, self.parts, self.sublinear, self.extra
        small = _raw(np.maximum(np.arange(256), 1), sublinear)

        def flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
            ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
            sizes = np.diff(ends) // np.dtype(kind).itemsize
            return np.frombuffer(column.buffers()[2], kind, sizes.sum(), int(ends[0])) if sizes.any() else np.zeros(0, kind), sizes

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for whole in batches:
                for a in range(0, whole.num_rows, PASS):
                    batch = whole.slice(a, PASS)
                    own = []
                    for k in range(parts):
                        (at, sizes), (tf, _), (over, _) = flat(batch.column(f"idx_{k}"), kind), flat(batch.column(f"tf_{k}"), np.uint8), flat(batch.column(f"over_{k}"), np.uint32)
                        x = np.take(small, tf)
                        if len(over):
                            x[tf == 255] = _raw(over, sublinear)
                        own.append((at.astype(np.int64), x, sizes, batch.column(f"len_{k}").to_numpy()))
                    more = np.stack([batch.column(f"more_{i}").to_numpy() for i in range(extra)], axis=1) if extra else np.zeros((batch.num_rows, 0))
                    total += of(batch.column("label").to_numpy(), own, more)
            yield pa.RecordBatch.from_pydict({"sum": pa.array([total.tobytes()], pa.binary())})

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                for line in batch.column("sum"):
                    total += np.frombuffer(line.as_buffer())
            yield pa.RecordBatch.from_pydict({"sum": pa.array([total.tobytes()], pa.binary())})

        cores = self.rows.sparkSession.sparkContext.defaultParallelism
        lines = self.rows.coalesce(cores).mapInArrow(work, "sum binary")
        if cores > LINES:  # the driver gets a line from few tasks, however many cores there are
            lines = lines.repartition(LINES).mapInArrow(added, "sum binary")
        return sum((np.frombuffer(line.as_buffer()) for line in lines.toArrow().column("sum")), np.zeros(width))

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each term and feature the weighted sums of its values and of their squares."""
        weights, wide = self.weights, len(self.idf) - self.extra

        def of(label, parts, more):
            w, out = weights[label.astype(int)], np.zeros((2, wide + more.shape[1]))
            for at, x, sizes, length in parts:
                out[0, :wide] += np.bincount(at, x * np.repeat(w / length, sizes), wide)
                out[1, :wide] += np.bincount(at, x * x * np.repeat(w / length**2, sizes), wide)
            out[:, wide:] = w @ more, w @ (more * more)
            return out.ravel()

        one, two = self._sums(of, 2 * len(self.idf)).reshape(2, -1)
        return one * self.idf, two * self.idf**2

    def slope(self, coefficients: np.ndarray, intercept: float) -> tuple[float, np.ndarray, float]:
        """The weighted logistic loss, and its slope by the coefficients and by the intercept."""
        weights, wide = self.weights, len(self.idf) - self.extra
        v = coefficients * self.idf

        def of(label, parts, more):
            margin = intercept + more @ v[wide:]
            for at, x, sizes, length in parts:
                full = sizes > 0
                if full.any():
                    margin[full] += np.add.reduceat(x * np.take(v, at), (np.cumsum(sizes) - sizes)[full]) / length[full]
            w = weights[label.astype(int)]
            error = w * (1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700))) - label)
            out = np.zeros(wide + more.shape[1] + 2)
            for at, x, sizes, length in parts:
                out[:wide] += np.bincount(at, x * np.repeat(error / length, sizes), wide)
            out[wide:-2] = error @ more
            out[-2:] = error.sum(), (w * np.logaddexp(0.0, np.where(label > 0, -margin, margin))).sum()
            return out

        out = self._sums(of, len(self.idf) + 2)
        return float(out[-1]), out[:-2] * self.idf, float(out[-2])
