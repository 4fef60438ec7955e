"""Source divergence, Merkle manifest and n-gram join against brute-force versions, with nulls, blanks, ties, repeats, long texts, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import partial

import pytest

from textward.llm import divergence, manifest, ngram_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, hash string, term string"
PROSE = "the quick brown fox jumps over the lazy dog and runs on to the river where it is cool and quiet for a while"


def documents():
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "The The the", PROSE, PROSE.upper(), PROSE + "\n" + PROSE, "é È 日本 \x0b tab\tz x1y2", "***" * 40, "word " * 30_000, "ab" * 600_000, "Ünder_score a-b"]
    texts += [" ".join(rng.choice(PROSE.split()) for _ in range(rng.randint(1, 30))).capitalize() for _ in range(150)]
    rows = [(k, t, [None, "", "en", "de", "é"][k % 5 if k < 60 else 2], [None, "a", "b", "c"][rng.randrange(4)], len(t or ""), 1, "h", "t") for k, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (5, "other", "en", "a", None, 1, "h", "t"), (None, "null id", "en", None, None, 1, "h", "t"), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def audited(rows, least):
    counts, docs_with, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs_with[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs_with[lang].items() if n >= least)
        total = Counter()
        for s in sources:
            total.update(counts[lang, s])
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        usual, own = share(total), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            often = sorted((usual[t] - own[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and own[s][t] > usual[t])[:50]
            out += [(lang, s, part, item, -v, k) for part, found in (("pair", pairs), ("term", often)) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def test_divergence(docs, rows, monkeypatch):
    want = audited(rows, 5)
    assert {w[2] for w in want} == {"pair", "term"}
    assert sorted(tuple(r) for r in divergence.audit(docs, least_docs=5).collect()) == want
    for name, small in (("BLOCK", 1), ("TERMS_OF_CELL", 3)):
        monkeypatch.setattr(divergence, name, small)
    monkeypatch.setattr(divergence, "_merged", partial(divergence._merged, most=10))
    assert sorted(tuple(r) for r in divergence.audit(docs, least_docs=5).collect()) == want


def test_terms_in_slices():
    raw = (PROSE + "\n1 é-B日 " + "x" * 300).encode() * 5
    assert divergence.terms_of(raw, 50) == divergence.terms_of(raw) and divergence.terms_of(raw)["é".encode()] == 5


def test_divergence_exact_shares(spark):
    """Counts near the end of a long stay exact, and a language without kept terms has distances of 0."""
    df = spark.createDataFrame([(9_000_000_000_000_000_000, 9_000_000_000_000_000_001, 7), (0, 1, 1)], "n long, total long, kinds long")
    got = [r[0] for r in df.select(divergence.share(df["n"], df["total"], df["kinds"])).collect()]
    assert got == [1 + 10**9 * (9_000_000_000_000_000_005) // (9_000_000_000_000_000_001 + 35), 1 + 10**9 * 5 // 6]
    few = spark.createDataFrame([(1, "x", "en", s) for s in "ab"], "doc_id long, text string, lang string, source string")
    assert sorted((r["source"], r["item"], r["value"], r["rank"]) for r in divergence.audit(few).collect()) == [("a", "b", 0, 1), ("b", "a", 0, 1)]


def proven(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, s, n: sha("".join(map(field, (i, s, lang, n, t))))
    trees = defaultdict(list)
    for i, t, lang, s, n, *_ in rows:
        own = leaf(i, t, lang, s, n)
        bad = leaf(i, re.sub("[A-Z]", lambda m: m[0].lower(), t), lang, s, n) if t is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else own
        trees[lang].append((i is not None, i or 0, own, bad, i))

    def paths(hashes):
        way = [[] for _ in hashes]
        at, level = list(range(len(hashes))), hashes
        while len(level) > 1:
            for k, w in enumerate(way):
                a = at[k] // 8 * 8
                w.append(("".join(level[a : at[k]]), "".join(level[at[k] + 1 : a + 8])))
                at[k] //= 8
            level = [sha("".join(level[a : a + 8])) for a in range(0, len(level), 8)]
        return level[0], way

    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {lang: paths([x[2] for x in sorted(trees[lang])]) for lang in langs}
    root, top = paths([own[lang][0] for lang in langs])
    out = []
    for lang, above in zip(langs, top):
        for (_, _, good, bad, i), way in zip(sorted(trees[lang]), own[lang][1]):
            folded = bad
            for left, right in way + above:
                folded = sha(left + folded + right)
            out.append((i, good, own[lang][0], root, sha("".join(a + b for a, b in way + above)), folded, folded == root))
    return Counter(out)


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_manifest(docs, rows, monkeypatch, digits):
    monkeypatch.setattr(manifest, "DIGITS", digits)
    found = Counter(tuple(r) for r in manifest.manifest(docs).collect())
    assert found == proven(rows)
    assert {k[-1] for k in found} == {True, False}


def test_manifest_of_one(spark, rows):
    """A single leaf is its own root, and many languages need more than one level of their own."""
    one = spark.createDataFrame(rows[:1], SCHEMA)
    assert Counter(tuple(r) for r in manifest.manifest(one).collect()) == proven(rows[:1])
    many = [(k, f"Text {k}", f"l{k % 70}", "s", 3, 1, "h", "t") for k in range(100)]
    assert Counter(tuple(r) for r in manifest.manifest(spark.createDataFrame(many, SCHEMA)).collect()) == proven(many)


def joined(rows):
    sets = []
    for i, t, *_ in rows:
        words = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))) if words else frozenset()))
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for b in range(len(sets)):
        for a in range(b):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[max(top(a), top(b))] = min(top(a), top(b))
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[top(k)].append((i is None, i or 0, i))
    return Counter((i, len(s), min(least[top(k)])[2]) for k, (i, s) in enumerate(sets))


def near_copies():
    """Clusters of edited copies, chains whose ends are far apart, templates whose fillings lie just below and above the bound."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(900)]
    rows = []

    def add(text):
        rows.append((len(rows), text, "en", "s", 1, 1, "h", "t"))

    for size in (8, 30, 60, 120):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(size)]
            for k in range(9):
                add(" ".join(base))
                for _ in range(1 if k % 2 else max(1, size // 60)):
                    base[rng.randrange(size)] = rng.choice(words)
    template = [rng.choice(words) for _ in range(150)]
    for k in range(60):
        filled = template + [f"own{k}x{j}" for j in range(rng.randint(1, 30))]
        add(" ".join(filled if k % 3 else filled[: rng.randint(140, 155)]))
    for _ in range(80):
        add(" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) + " " + " ".join(template[:20]))
    return rows


def test_shingles_differ():
    """Words in another order or number are another shingle."""
    texts = ["a b b a", "b a a b", "a b a b", "b a b a", "a a b b", "b b a a", "a a a b", "a b b b", "a", "a a", "a a a", "a a a a", "a b", "b a", "a b a"]
    assert len({int(ngram_join.shingles_of(t.encode())[1][0]) for t in texts}) == len(texts)
    assert ngram_join.shingles_of(b"A b\tc\x0bd a b c D")[0] == 4


def test_ngram_join(docs, rows):
    assert Counter(tuple(r) for r in ngram_join.join(docs).collect()) == joined(rows)


def test_ngram_join_near_copies(spark, monkeypatch):
    rows = near_copies()
    want = joined(rows)
    sizes = Counter(c for _, _, c in want)
    assert max(sizes.values()) > 20 and 40 < len(sizes) < len(rows) - 100
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    assert Counter(tuple(r) for r in ngram_join.join(docs).collect()) == want
    # common shingles, full blocks and buckets, long lists, hot keys
    for name, small in (("COMMON", 12), ("COMMON_SHARE", 1 << 40), ("REPORTED", 2), ("HOT_LIST", 4), ("BUCKET", 500), ("BLOCK", 2000), ("SEEN", 5)):
        monkeypatch.setattr(ngram_join, name, small)
    monkeypatch.setattr(ngram_join, "hot_values", lambda df, column: [r[0] for r in df.select(column).distinct().limit(40).collect()])
    assert Counter(tuple(r) for r in ngram_join.join(docs).collect()) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for out in (divergence.audit(none), manifest.manifest(none), ngram_join.join(none)):
        assert out.count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None, None, None, None), (None, " ", None, None, None, None, None, None)], SCHEMA)
    assert {tuple(r) for r in ngram_join.join(blank).collect()} == {(1, 0, 1), (None, 0, None)}
