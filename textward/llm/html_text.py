"""HTML extraction by equivalence classes of template tokens.

Pages are scanned once into tag tokens and text blocks (html_scan.py) and kept as a table. Over the different pages of
a host, tokens with the same occurrence vector (how often each page has them) form an equivalence class. A class can be
part of the template when it is on two pages or more, has two tokens or more and a tag among them. It is valid when its
tokens come in the same order on every page, and when on every page it lies in the same gap between two tokens of the
class around it (or in none): so valid classes nest, the class of all pages outermost, and together are the template.

The template then chooses the article. Its containers form a tree; over all pages of the host each is weighed by the page's
own text in it: not in links, not template text itself, not in an element named as a menu, footer and the like. The
innermost container with more than MAIN_SHARE of the host's own text is the main one. Beside it and its containers, a
container stays if it holds KEPT_SHARE of the main one's text or a first heading on most pages, and is not mostly links;
what is shorter (adverts, footers, notices, whatever their words) goes. Text between containers is judged alike by its
slot, the template token before it; slots that are mostly links go everywhere. Names break ties: inside what the template
chose, parts with a role's name go, and an element made for articles is the article. They decide alone where a host
has no template, as with one page.

Vectors are compared by a sum of hashes over (page, count): equal pages count alike for all their tokens, so they
change no comparison, and a host with a third of all pages is an ordinary partial aggregation. Order and nesting are
checked page by page, with a page's own tokens as the largest group.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_salts, hot_values, salt, written
from .html_scan import HEADING, MADE, PLAIN, ROLE, Scanner
from .url_rules import parts

#: Templates of this size together (100 bytes a token in a Python dict) are broadcast; beyond it each page's own tokens are joined with them, hot hosts salted.
BROADCAST_BYTES = 32_000_000
SALTS = 64
#: A slot with more than this share of its characters inside links is a menu.
MENU_SHARE = 0.5
#: The main container holds more than this share of the host's own text; beside it stays what has this share of the main one's text.
MAIN_SHARE = 2 / 3
KEPT_SHARE = 0.1
#: What a token is to its host, as bits: template; as a slot mostly links or short; as a container around the main one, the main one, kept beside it.
TEMPLATE, MENU, SHORT, AROUND, MAIN, KEPT = 1, 2, 4, 8, 16, 32
_ROWS = 256

_BLOCKS = "at array<int>, links array<int>, chars array<int>, kind array<tinyint>, token array<long>, inside array<int>, boxes array<int>, up array<int>"
_SCANNED = f"page_id long, url string, host string, page long, tags array<long>, {_BLOCKS}, text array<string>"


def _lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array([x for v in values for x in v], kind))


def scanned(pages: DataFrame) -> DataFrame:
    """A row per page: its tags in order and its text blocks, as parallel arrays."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for whole in batches:
            for start in range(0, len(whole), _ROWS):
                batch = whole.slice(start, _ROWS)
                html = [p.as_py() or "" for p in batch.column("html")]
                found = [scanner.scan(p) for p in html]
                keys = [xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) - (1 << 63) for p in html]
                yield pa.RecordBatch.from_pydict(
                    {
                        "page_id": batch.column("page_id"),
                        "url": batch.column("url"),
                        "host": pa.array([parts(u.as_py())[0] for u in batch.column("url")], pa.string()),
                        "page": pa.array(keys, pa.int64()),
                        "tags": _lists([f.tags for f in found], pa.int64()),
                        "at": _lists([f.at for f in found], pa.int32()),
                        "links": _lists([f.links for f in found], pa.int32()),
                        "chars": _lists([[len(t) for t in f.text] for f in found], pa.int32()),
                        "kind": _lists([f.kind for f in found], pa.int8()),
                        "token": _lists([f.token for f in found], pa.int64()),
                        "inside": _lists([f.inside for f in found], pa.int32()),
                        "boxes": _lists([f.boxes for f in found], pa.int32()),
                        "up": _lists([f.up for f in found], pa.int32()),
                        "text": _lists([f.text for f in found], pa.string()),
                    }
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(work, _SCANNED)


_OCCURS = "host string, page long, token long, n int, first int, last int, tag boolean"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, page, token, how often, first and last place, and whether it is a tag; a page itself is token 0."""
    for whole in batches:
        for start in range(0, len(whole), _ROWS):
            rows = []
            for r in whole.slice(start, _ROWS).to_pylist():
                seen: dict[int, list] = {0: [1, -1, -1, True]}
                places = [(2 * k + 1, t, True) for k, t in enumerate(r["tags"])]
                places += [(2 * k, t, False) for k, t, kind in zip(r["at"], r["token"], r["kind"]) if kind in (PLAIN, HEADING)]
                for place, token, tag in places:
                    own = seen.setdefault(token, [0, place, place, tag])
                    own[0] += 1
                    own[1], own[2] = min(own[1], place), max(own[2], place)
                rows += [(r["host"], r["page"], token, *own) for token, own in seen.items()]
            names = [x.split()[0] for x in _OCCURS.split(", ")]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


@dataclass
class Span:
    """Where a class lies on a page: its tokens' first and last places, outer limits, rank and order."""

    name: str
    rank: tuple
    marks: list[tuple[int, int]]
    order: int


def nest(tokens: list[dict]) -> list[tuple[str, int, int]]:
    """Of one page's class tokens: each class, a hash of its tokens' order, and the gap it lies in (0: no class around it).

    tokens have class, rows, size, token, first, last. The class around another is the smallest whose span holds its
    span. Of two classes whose spans cross, the one on fewer pages (then of fewer tokens) does not nest; nor does a class
    that has a first or last place of the class around it inside its span. Those have gap -1 and are around no other.
    """
    classes: dict[str, list[dict]] = defaultdict(list)
    for t in tokens:
        classes[t["class"]].append(t)
    spans = []
    for name, own in classes.items():
        marks = sorted({(t[end], t["token"]) for t in own for end in ("first", "last")})
        order = [[t["token"] for t in sorted(own, key=lambda t: t[end])] for end in ("first", "last")]
        spans.append(Span(name, (-own[0]["rows"], -own[0]["size"], name), marks, xxhash.xxh64_intdigest(repr(order).encode()) >> 1))
    gaps: dict[str, int] = {}
    around: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.marks[0][0], -s.marks[-1][0])):
        lo, hi = s.marks[0][0], s.marks[-1][0]
        while around and around[-1].marks[-1][0] < lo:
            around.pop()
        while around and around[-1].marks[-1][0] < hi and around[-1].rank > s.rank:
            gaps[around.pop().name] = -1
        gap = 0
        if around:
            outer = around[-1].marks
            k = bisect_left(outer, (lo,))
            if outer[-1][0] < hi or k < bisect_left(outer, (hi,)):
                gap = -1
            else:
                gap = xxhash.xxh64_intdigest(f"{around[-1].name} {outer[k - 1][1]}".encode()) >> 1
        gaps[s.name] = gap
        if gap >= 0:
            around.append(s)
    return [(s.name, s.order, gaps[s.name]) for s in spans]


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r["host"], *found) for r in batch.to_pylist() for found in nest(r["own"])]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["host", "class", "order", "gap"])


def _host_join(rows: DataFrame, per_host: DataFrame, key: Column, hot: list[str], on: list[str], how: str = "inner") -> DataFrame:
    """rows with what their host has; the rows of hot hosts are dealt by key to many tasks."""
    spread = per_host.withColumn("salt", F.explode(all_salts(F.col("host"), hot, SALTS)))
    return rows.withColumn("salt", salt(F.col("host"), hot, key, SALTS)).join(spread, [*on, "salt"], how).drop("salt")


def templates(pages: DataFrame) -> DataFrame:
    """host, token: the tokens of all valid classes, for hosts with two different pages or more."""
    seen = written(pages.select("host", "page", "tags", "at", "token", "kind").mapInArrow(_occurrences, _OCCURS), "html-occurrences")
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")).cast("string")
    found = seen.groupBy("host", "token").agg(vector.alias("class"), F.count(F.lit(1)).alias("rows"), F.min("page").alias("lo"), F.max("page").alias("hi"), F.first("tag").alias("tag"))
    found = written(found.where("lo <> hi").drop("lo", "hi"), "html-tokens")
    sizes = found.groupBy("host", "class").agg(F.count(F.lit(1)).alias("size"), F.count_if("tag").alias("tags")).where("size > 1 AND tags > 0")
    frequent = written(found.join(sizes, ["host", "class"]).select("host", "token", "class", "rows", "size"), "html-classes")
    hot = hot_values(pages.select("host"), "host")
    own = _host_join(seen, frequent, F.col("page"), hot, ["host", "token"])
    own = own.groupBy("host", "page").agg(F.collect_set(F.struct("class", "rows", "size", "token", "first", "last")).alias("own"))
    checked = own.select("host", "own").mapInArrow(_nested, "host string, class string, order long, gap long")
    valid = checked.groupBy("host", "class").agg(F.min("order").alias("o1"), F.max("order").alias("o2"), F.min("gap").alias("g1"), F.max("gap").alias("g2"))
    valid = valid.where("o1 = o2 AND g1 = g2 AND g1 >= 0").select("host", "class")
    return frequent.join(valid, ["host", "class"]).select("host", "token")


def slots_of(tags: list[int], at: list[int], marks: dict[int, int]) -> list[int]:
    """The slot of each block: the last template tag before it, 0 before the first."""
    out, slot, k = [], 0, 0
    for place in at:
        while k < place:
            slot = tags[k] if marks.get(tags[k], 0) & TEMPLATE else slot
            k += 1
        out.append(slot)
    return out


def _marked(rows: DataFrame, marks: DataFrame, work: Callable[[dict, dict[int, int]], Iterable[tuple]], schema: str) -> DataFrame:
    """rows through work(row as dict, bits of its host's tokens), each result a tuple of schema's columns or several.

    Small templates are broadcast. Beyond that a row gets the bits of its own page's tokens only, so none grows with its host.
    """

    def batches_of(line: Callable[[dict], dict[int, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrow = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
            columns = [c.split() for c in schema.split(", ")]
            for whole in batches:
                for start in range(0, len(whole), _ROWS):
                    made = [m for r in whole.slice(start, _ROWS).to_pylist() for m in work(r, line(r))]
                    yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], arrow[t]) for k, (_, t) in enumerate(columns)], names=[c for c, _ in columns])

        return run

    if marks.count() * 100 <= BROADCAST_BYTES:
        lines: dict[str, dict[int, int]] = defaultdict(dict)
        for host, token, bits in marks.select("host", "token", "bits").collect():
            lines[host][token] = bits
        sent = rows.sparkSession.sparkContext.broadcast(dict(lines))
        return rows.mapInArrow(batches_of(lambda r: sent.value.get(r["host"], {})), schema)
    hot = hot_values(rows.select("host"), "host")
    own = rows.select("host", "page", "tags", "token").dropDuplicates(["host", "page"])
    own = own.select("host", "page", F.explode(F.array_distinct(F.concat("tags", "token", F.array(F.lit(0).cast("long"))))).alias("token"))
    own = _host_join(own, marks.select("host", "token", "bits"), F.col("page"), hot, ["host", "token"])
    own = written(own.groupBy("host", "page").agg(F.collect_list("token").alias("marked"), F.collect_list("bits").alias("bits")), "html-marks")
    # copies of one page share its key: those of a hot host are dealt by a draw from their own columns
    joined = _host_join(rows, own, F.struct(*[c for c in ("page_id", "url") if c in rows.columns] or ["page"]), hot, ["host", "page"], "left")
    return joined.mapInArrow(batches_of(lambda r: dict(zip(r["marked"] or (), r["bits"] or ()))), schema)


_SUMS = "host string, box int, number long, up long, depth int, pages long, own long, links long, heads long"


def _weights(row: dict, marks: dict[int, int]) -> Iterator[tuple]:
    """What a page adds to its host's sums: a row per template container (number 0: the page) with all it holds, and per slot."""
    if not marks:
        return
    tags, boxes = row["tags"], row["boxes"]
    in_template = lambda n: marks.get(n, 0) & TEMPLATE
    slots: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    # by place among the boxes plus one, 0 for the page: nearest template container, its depth, own characters, in links, headings
    near, depth = [0], [0]
    for k, (box, up) in enumerate(zip(boxes, row["up"]), 1):
        outer = near[up + 1]
        near.append(k if in_template(tags[box]) else outer)
        depth.append(depth[outer] + 1)
    sums = [[0, 0, 0] for _ in near]
    for slot, chars, links, kind, token, inside in zip(slots_of(tags, row["at"], marks), row["chars"], row["links"], row["kind"], row["token"], row["inside"]):
        if kind == ROLE:
            continue
        if kind != MADE:
            slots[slot][0] += chars - links
            slots[slot][1] += links
        if kind == MADE or not in_template(token):
            own = sums[near[inside + 1]]
            own[0] += chars - links
            own[1] += links
            own[2] = max(own[2], int(kind == HEADING))
    number = lambda k: tags[boxes[k - 1]] if k else 0
    for k in range(len(near) - 1, -1, -1):
        if near[k] == k:
            outer = near[row["up"][k - 1] + 1] if k else 0
            if k:
                own = sums[outer]
                sums[outer] = [own[0] + sums[k][0], own[1] + sums[k][1], max(own[2], sums[k][2])]
            yield (row["host"], 1, number(k), number(outer), depth[k], 1, *sums[k])
    yield from ((row["host"], 0, slot, 0, 0, 1, *s, 0) for slot, s in slots.items())


def chosen(pages: DataFrame, found: DataFrame) -> DataFrame:
    """host, token, bits: what every template token is to its host, from sums over all the host's pages."""
    start = found.select("host", "token", F.lit(TEMPLATE).alias("bits"))
    sums = _marked(pages, start, _weights, _SUMS).groupBy("host", "box", "number", "up")
    sums = written(sums.agg(F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("pages", "own", "links", "heads")]), "html-sums")
    boxes, slots = sums.where("box = 1").drop("box"), sums.where("box = 0")
    total = boxes.where("depth = 0").select("host", F.col("own").alias("total"))
    # more than half of the text can only be in containers around each other, so the deepest is one
    around = boxes.join(total, "host").where(F.col("own") > MAIN_SHARE * F.col("total")).unionByName(boxes.where("depth = 0").join(total, "host").where("total = 0"))
    main = around.groupBy("host").agg(F.max_by("number", "depth").alias("main"), F.max_by("own", "depth").alias("main_own"))
    around = around.join(main, "host").select("host", "number", "main", "main_own", F.when(F.col("number") == F.col("main"), MAIN | AROUND).otherwise(AROUND).alias("bits"))
    links = F.col("links") > MENU_SHARE * (F.col("own") + F.col("links"))
    beside = boxes.where("depth > 0").join(around.where("number <> main").select("host", F.col("number").alias("up"), "main_own"), ["host", "up"])
    beside = beside.join(around.select("host", "number"), ["host", "number"], "left_anti")
    beside = beside.where(~links & ((F.col("own") >= KEPT_SHARE * F.col("main_own")) | (2 * F.col("heads") > F.col("pages"))))
    short = F.when(F.col("own") < KEPT_SHARE * F.col("main_own"), SHORT).otherwise(0)
    judged = slots.join(main, "host").select("host", "number", short.bitwiseOR(F.when(links, MENU).otherwise(0)).alias("bits"))
    told = around.select("host", "number", "bits").unionAll(beside.select("host", "number", F.lit(KEPT).alias("bits"))).unionAll(judged.where("bits > 0"))
    return start.unionAll(told.withColumnRenamed("number", "token")).groupBy("host", "token").agg(F.bit_or("bits").alias("bits"))


_ABOVE, _IN, _OUT = 0, 1, 2


def article(row: dict, marks: dict[int, int]) -> str:
    """The text of a page by its host's template, or without one."""
    bits = lambda n: marks.get(n, 0)
    tags = row["tags"]
    state = [_IN if bits(0) & MAIN or not marks else _ABOVE]
    for box, up in zip(row["boxes"], row["up"]):
        outer, own = state[up + 1], bits(tags[box])
        if outer == _ABOVE and own & TEMPLATE:
            outer = _IN if own & (MAIN | KEPT) else _ABOVE if own & AROUND else _OUT
        state.append(outer)
    made, own, all_made, all_own, rest = [], [], [], [], []
    for text, kind, token, inside, slot in zip(row["text"], row["kind"], row["token"], row["inside"], slots_of(tags, row["at"], marks)):
        if kind == ROLE:
            continue
        where = state[inside + 1]
        stays = where == _IN or where == _ABOVE and (kind != PLAIN or not bits(slot) & SHORT)
        if kind == MADE:
            all_made.append(text)
            made += [text] if stays else []
        else:
            rest.append(text)
            if not bits(token) & TEMPLATE and not bits(slot) & MENU:
                all_own.append(text)
                own += [text] if stays else []
    return "\n".join(made or own or all_made or all_own or rest)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row: its main text, blocks joined by \\n.

    Null html counts as empty and gives an empty text. Pages of a null or hostless url share the template of the empty
    host. A host with one page, or with equal pages only, has no template: elements and names alone decide there.
    Repeated rows give the same text each. A page without text where its host has the article gives all its own text;
    one of template text and menus only gives those. Pages of any length and depth cost memory in proportion. Other
    columns are not read.
    """
    rows = written(scanned(pages), "html-pages")
    found = written(templates(rows), "html-templates")
    lean = rows.select("host", "page", "tags", "at", "links", "chars", "kind", "token", "inside", "boxes", "up")
    marks = written(chosen(lean, found), "html-choice")
    whole = rows.select("page_id", "url", "host", "page", "tags", "at", "kind", "token", "text", "inside", "boxes", "up")
    out = _marked(whole, marks, lambda row, bits: [(row["page_id"], row["url"], article(row, bits))], "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
