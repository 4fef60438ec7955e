"""HTML extraction against a brute-force version of classes, nesting and slots, on made-up sites."""

import html as entities
import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from textward.llm import html_text
from textward.llm.html_scan import BESIDE, CONTAINERS, DROPPED, INLINE, RAW, ROLES, Scanner

SCHEMA = "page_id long, url string, html string, host string, tags string"
PAGE = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href='/x'>menu</a></nav><div class='ad'>buy</div><article><h1>Head</h1><p>one &amp;  two<p><b>three</b> four<br>five</article><div class='comments'><p>reader</p></div><footer>&copy; x</footer></body></html>"


def extracted(spark, rows):
    frame = spark.createDataFrame([(k, u, h, "clash", "clash") for k, (u, h) in enumerate(rows)], SCHEMA)
    got = {r["page_id"]: r for r in html_text.main_text(frame).collect()}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got.values())
    return [got[k]["text"] for k in range(len(rows))]


class Plain(HTMLParser):
    """Tokens as spelled-out paths; well-formed pages only."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.path, self.places, self.blocks, self.text, self.linked, self.in_link, self.raw = [("", "plain")], [], [], "", 0, False, False
        self.boxes, self.heading, self.alike = [], False, Counter()
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        t = " ".join(self.text.split())
        if t:
            self.blocks.append((len(self.places), t, self.path[-1][1], min(self.linked, len(t)), self.path[-1][0], self.heading))
            self.places.append(f"{self.path[-1][0]} text {t}" if self.path[-1][1] == "plain" else None)
        self.text, self.linked = "", 0

    def handle_data(self, data):
        if not self.raw:
            self.text += data
            self.linked += len(data) if self.in_link else 0

    def handle_starttag(self, tag, attrs):
        self.in_link = True if tag == "a" else self.in_link
        if tag in INLINE:
            return
        self.flush()
        self.heading = tag == "h1"
        path, kind = self.path[-1]
        names = (dict(attrs).get("class") or "").split()
        label = f"{path}>{tag}" + "".join(f".{w}" for w in sorted({w for n in names for w in re.findall("[a-z]+", n)}))
        if tag in CONTAINERS | RAW:
            self.alike[label] += 1
            label += f" {self.alike[label]}" if self.alike[label] > 1 else ""
        self.places.append(label)
        if tag in RAW:
            self.raw = True
        elif tag in CONTAINERS:
            parts = [re.findall("[a-z]+", n) for n in names]
            role = any(any(w in ROLES for w in p) and all(w in ROLES | BESIDE for w in p) for p in parts)
            drop = role or tag in DROPPED or (tag == "header" and kind != "made")
            inner = "role" if drop or kind == "role" else "made" if tag in ("article", "main") else kind
            if kind == "plain" and inner != "role":
                self.boxes.append(label)
            self.path.append((label, inner))

    def handle_endtag(self, tag):
        self.in_link = False if tag == "a" else self.in_link
        if tag in INLINE:
            return
        self.flush()
        self.heading = False
        if tag in RAW:
            self.raw = False
        elif tag in CONTAINERS:
            self.places.append(self.path.pop()[0] + "/")
        else:
            self.places.append(f"{self.path[-1][0]}>/{tag}")


def chosen(pages, template, slots, sums, keys):
    """Which blocks the main container, what stays beside it and long slots between hold; every container looked up for every block."""
    inside = lambda path, box: box in ("", path) or path.startswith(box + ">")
    weight = {}
    for page in pages:
        for box in ["", *(b for b in page.boxes if b in template)]:
            own = [b for b in page.blocks if b[2] != "role" and inside(b[4], box) and (b[2] == "made" or page.places[b[0]] not in template)]
            w = weight.setdefault(box, [0, 0, 0, 0])
            for n, v in enumerate((sum(len(b[1]) - b[3] for b in own), sum(b[3] for b in own), any(b[5] and b[2] == "plain" for b in own), 1)):
                w[n] += v
    total = weight[""][0]
    around = [box for box, w in weight.items() if w[0] > html_text.MAIN_SHARE * total or not total and not box]
    main = max(around, key=len)
    least = html_text.KEPT_SHARE * weight[main][0]
    parent = {box: max((c for c in weight if c != box and inside(box, c)), key=len) for box in weight if box}
    kept = [b for b, up in parent.items() if b not in around and up in around and up != main and weight[b][1] <= weight[b][0] and (weight[b][0] >= least or 2 * weight[b][2] > weight[b][3])]
    boxes = dict(zip(keys, pages))

    def stays(key, block):
        for box in sorted((b for b in ["", *boxes[key].boxes] if (not b or b in template) and inside(block[4], b)), key=len):
            if box == main or box in kept:
                return True
            if box not in around:
                return False
        return block[2] == "made" or block[5] or sums[slots[key, block[0]]][0] >= least

    return stays


def brute(rows):
    """All pages in memory, every pair of classes compared."""
    out = [None] * len(rows)
    hosts = {}
    for k, (url, page) in enumerate(rows):
        hosts.setdefault(url.split("://")[1].split("/")[0], []).append((k, page))
    for pages in hosts.values():
        different = {p: Plain(p) for _, p in pages}
        vectors = {}
        for i, page in enumerate(different.values()):
            for t in page.places:
                if t is not None:
                    vectors.setdefault(t, [0] * len(different))[i] += 1
        classes = {}
        for t, v in vectors.items():
            if sum(n > 0 for n in v) > 1:
                classes.setdefault(tuple(v), set()).add(t)
        classes = {v: c for v, c in classes.items() if len(c) > 1 and any(" text " not in t for t in c)}
        better = sorted(classes, key=lambda v: (-sum(n > 0 for n in v), -len(classes[v])))
        shape, bad = {v: set() for v in classes}, set()
        for i, page in enumerate(different.values()):
            where = {}
            for at, t in enumerate(page.places):
                where.setdefault(t, []).append(at)
            span = {v: (min(where[t][0] for t in c), max(where[t][-1] for t in c)) for v, c in classes.items() if v[i]}
            here = set(span)
            for v in better:  # of two that cross, the worse goes
                for w in better[: better.index(v)]:
                    if {v, w} <= here:
                        (a, b), (c, d) = sorted((span[v], span[w]))
                        if a < c <= b < d:
                            here.discard(v)
                            bad.add(v)
            for v in sorted(here, key=lambda v: (span[v][0], -span[v][1])):
                if v not in here:
                    continue
                holding = [w for w in here if w != v and span[w][0] < span[v][0] and span[v][1] < span[w][1]]
                gap = None
                if holding:
                    outer = min(holding, key=lambda w: span[w][1] - span[w][0])
                    marks = sorted({(where[t][e], t) for t in classes[outer] for e in (0, -1)})
                    if any(span[v][0] < m < span[v][1] for m, _ in marks):
                        bad.add(v)
                        here.discard(v)
                        continue
                    gap = (outer, max(m for m in marks if m[0] < span[v][0])[1])
                order = tuple(tuple(sorted(classes[v], key=lambda t: where[t][e])) for e in (0, -1))
                shape[v].add((order, gap))
        template = set().union(*(classes[v] for v in classes if v not in bad and len(shape[v]) == 1))
        slots, sums = {}, {}
        for p, page in different.items():
            for at, *_ in page.blocks:
                before = [x for x in page.places[:at] if x in template and " text " not in x]
                slots[p, at] = before[-1] if before else None
        for _, p in pages:
            for at, t, kind, links, *_ in different[p].blocks:
                if kind == "plain":
                    own = sums.setdefault(slots[p, at], [0, 0])
                    own[0] += len(t) - links
                    own[1] += links
        stays = chosen([different[p] for _, p in pages], template, slots, sums, [p for _, p in pages]) if template else lambda p, block: True
        for k, p in pages:
            blocks = [b for b in different[p].blocks if b[2] != "role"]
            menu = lambda at: template and sums[slots[p, at]][1] > sums[slots[p, at]][0]
            site = lambda b: different[p].places[b[0]] in template or menu(b[0])
            made = [b for b in blocks if b[2] == "made"]
            own = [b for b in blocks if b[2] == "plain" and not site(b)]
            kept = [[b for b in made if stays(p, b)], [b for b in own if stays(p, b)], made, own, [b for b in blocks if b[2] == "plain"], []]
            out[k] = "\n".join(b[1] for b in next((c for c in kept if c), []))
    return out


def site(rng, k):
    """A page of a site without an article element: some parts on all pages, some on a few, some repeated."""
    word = lambda n: " ".join(rng.choice("river stone light under seven apple window orange paper").__str__() + rng.choice(["a", "b", "c", "d"]) for _ in range(n))
    links = lambda n: "".join(f"<li><a href='/{rng.random()}'>{word(2)}</a></li>" for _ in range(n))
    vocabulary = "river stone light under seven apple window orange paper".split()
    word = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    top = f"<div class='top'><p>Welcome &amp; hello</p><ul>{links(4)}</ul></div>"
    note = "<section><p>We moved to a new house</p></section>" if rng.random() < 0.5 else ""
    body = "".join(f"<p>{word(rng.randint(3, 20))}</p>" for _ in range(rng.randint(1, 5)))
    cards = "".join(f"<figure><a href='x'>{word(3)}</a></figure>" for _ in range(rng.choice([2, 3])))
    low = "<div class='low'><p>All rights kept</p></div>" if rng.random() < 0.8 else ""
    swapped = [f"<div class='text'><h1>{word(4)}</h1>{body}</div>", f"<table><tr><td>{cards}</td></tr></table>"]
    if rng.random() < 0.2:
        swapped.reverse()
    return f"<html><head><title>{word(2)}</title></head><body>{top}{note}{''.join(swapped)}{low}</body></html>"


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for h in range(12):
        for k in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((f"http://h{h}.example/{k}", site(rng, k)))
    rows += rows[:5] + [("http://h3.example/again", rows[9][1])]
    want = brute(rows)
    assert extracted(spark, rows) == want
    alone = [html_text.article(vars(p), {}) for p in (Scanner().scan(h) for _, h in rows)]
    assert sum(a != b for a, b in zip(alone, want)) > len(rows) // 2  # the templates act
    assert any("Welcome & hello" in a for a in alone) and sum("Welcome & hello" in b for b in want) < sum("Welcome & hello" in a for a in alone)
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", 0)
    assert extracted(spark, rows) == want
    monkeypatch.setattr(html_text, "hot_values", lambda rows, column: ["h0.example", "h1.example", "h2.example"])
    assert extracted(spark, rows) == want


def test_pages(spark):
    urls = ["http://a.example/1", "http://a.example/2", None, "nothing"]
    rows = list(zip(urls * 2, [PAGE, PAGE.replace("five", "six"), None, "", "<p>bare", "plain <b>text</b>", PAGE[:200], "<article>" * 3 + "deep"]))
    got = extracted(spark, rows)
    assert got[0] == "Head\none & two\nthree four\nfive"
    assert [got[k] for k in (2, 3, 4, 5, 7)] == ["", "", "bare", "plain text", "deep"]
    assert got[1].endswith("six") and got[6].startswith("Head")


def test_template_without_roles(spark):
    """No article element: menus by their slots, and blocks of the template, are left out."""
    page = "<html><body><div id=a><a href=x>one</a><a href=y>two</a></div><div id=b><p>Same on all pages</p><p>own text number {} is long enough to win</p></div></body></html>"
    assert extracted(spark, [(f"http://h.example/{k}", page.format(k)) for k in range(3)]) == [f"own text number {k} is long enough to win" for k in range(3)]


def test_repeats_are_no_template(spark):
    """Equal pages count once; blocks of an article stay, also those that equal a line of the site elsewhere."""
    plain = "<html><body><div><p>The whole text</p><p>of one page</p></div></body></html>"
    both = "<html><body><p>site line</p><article><h1>Shared head</h1><p>site line</p><p>own {}</p></article></body></html>"
    rows = [("http://rows.example/1", plain)] * 8 + [(f"http://pages.example/{k}", plain) for k in range(8)] + [(None, PAGE)] * 8
    rows += [(f"http://both.example/{k}", both.format(k)) for k in range(8)]
    got = extracted(spark, rows)
    assert got[:16] == ["The whole text\nof one page"] * 16 and got[16:24] == ["Head\none & two\nthree four\nfive"] * 8
    assert got[24:] == [f"Shared head\nsite line\nown {k}" for k in range(8)]


def test_names(spark):
    """What is inside an article stays, unless its whole name is a role's."""
    page = "<article><header><h1>The title</h1></header><div class='social-context'>A paragraph</div><div class='content-widget'>body</div><div class='share-buttons'>x</div><div id='comments'>y</div><aside>z</aside><footer>by</footer></article>"
    assert extracted(spark, [("http://n.example/", page), ("http://m.example/", "<main>a<nav>b</nav></main><div class='site-footer'>c</div><form>d</form>e")]) == ["The title\nA paragraph\nbody", "a"]


def test_odd_and_long_pages(spark):
    """Unclosed tags, stray quotes, references, depth: linear, and the text is whole."""
    deep = "<div>" * 100_000 + "deep"
    words = "<p>" + "word " * 200_000
    rows = [(None, deep), ("http://x.example/1", deep), ("http://x.example/2", deep + "er"), ("u", words), ("v", "<x " * 100_000 + '"'), ("w", "a &lt; b <3 &#x41;&nbsp;<p title='>'>c<!-- d -->e<![x]>f"), ("x", "<p>g<a href='")]
    got = extracted(spark, rows)
    assert got[:3] == ["deep", "deep", "deeper"] and got[3] == ("word " * 200_000).strip() and got[4:] == ["", "a < b <3 A\nc e f".replace(" e f", "ef"), "g"]
    assert entities.unescape("&#x41;") == "A"


def test_empty(spark):
    assert html_text.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("first, second, gaps", [((1, 9), (2, 5), (0, 1)), ((1, 5), (3, 9), (0, -1)), ((1, 3), (5, 9), (0, 0))])
def test_nest(first, second, gaps):
    """Nested, crossing and separate spans; the class on fewer pages gives way."""
    made = [{"class": c, "rows": rows, "size": 2, "token": 10 * n + k, "first": p, "last": p} for n, (c, rows, span) in enumerate((("a", 9, first), ("b", 4, second)), 1) for k, p in enumerate(span)]
    assert [min(g, 1) for _, _, g in html_text.nest(made)] == list(gaps)


def unnamed(rng, k):
    """A page whose parts are told by no name: menu, advert, article and footer are div elements with words of their own."""
    vocabulary = "river stone light under seven apple window orange paper".split()
    word = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randint(0, 99)) for _ in range(n))
    menu = "".join(f"<li><a href='/{rng.random()}'>{word(2)}</a></li>" for _ in range(5))
    body = [word(rng.randint(1, 30)) for _ in range(rng.randint(3, 9))]
    text = [word(5), *body]
    inner = f"<h1>{text[0]}</h1>" + "".join(f"<p>{b}</p>" for b in body)
    return f"<html><body><div><ul>{menu}</ul></div><div>{word(6)}</div><div>{inner}</div><div>&copy; h.example {word(4)}</div></body></html>", "\n".join(text)


def test_template_chooses(spark, monkeypatch):
    """Adverts and footers with words of their own go by their place; the title in a part of its own and a long second part stay."""
    rng = random.Random(9)
    pages = [unnamed(rng, k) for k in range(20)]
    rows = [(f"http://h.example/{k}", page) for k, (page, _) in enumerate(pages)] + [(f"http://one.example/{k}", pages[0][0]) for k in range(2)]
    parts = "<html><body><div><h1>Title {0}</h1></div><div><p>{1}</p><p>{1}</p></div><div><p>{2}</p></div><div>note {0}</div></body></html>"
    rows += [(f"http://parts.example/{k}", parts.format(k, f"long text {k} " * 30, f"second part {k} " * 6)) for k in range(6)]
    want = brute(rows)
    assert want[:20] == [text for _, text in pages]
    assert want[22:] == [f"Title {k}\n" + "\n".join([(f"long text {k} " * 30).strip()] * 2 + [(f"second part {k} " * 6).strip()]) for k in range(6)]
    assert extracted(spark, rows) == want
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(html_text, "hot_values", lambda rows, column: ["h.example", "one.example"])
    assert extracted(spark, rows) == want
