"""Each operator against a brute-force version, with nulls, blanks, repeats, ties, long texts, clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from textward.llm import ctw, exact_dedup, html_text, line_dedup, mixing, near_dup, pieces, quality, tokens, url_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, salt int, in_0 string, rank int"
PROSE = "the quick brown fox jumps over the lazy dog and runs on to the river where it is cool and quiet for a while"
TEXTS = [
    None, "", " \t\n", "one", "one ", "o n e", "The The the", PROSE, PROSE + " ", PROSE.replace("quick", "quiet"), PROSE + "\n" + PROSE,
    "a b c\nd e f\ng h i\nj k l", "x\na b c\nd e f\ng h i\ny", "***" * 40, "é È 日本 \x0b tab\tz", "word " * 30_000, "ab" * 20_000, "a b", "<s> </s> <unk> ▁x",
    " ".join(f"w{k}" for k in range(300)),
]


def table(spark, texts=TEXTS, ids=None):
    rows = [(k if ids is None else ids[k], t, "en", [None, "a", "b", ""][k % 4], 0, 7, "z", 1) for k, t in enumerate(texts)]
    rows += [rows[7], rows[0], (None, "null id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)] if ids is None else []
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_exact_dedup(docs, rows):
    bare = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t)
    groups = defaultdict(list)
    for i, t in rows:
        groups[bare(t)].append((-len(t), i is None, i or 0, i))
    found = exact_dedup.mark_copies(docs).collect()
    assert len(found) == len(rows)
    want = Counter()
    for i, t in rows:
        g = groups[bare(t)]
        want[i, min(g)[3], len(g)] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == want
    assert sum(r["kept"] for r in found) == len(groups)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_dedup_salted(spark):
    many = spark.range(0, 4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 < 2 THEN repeat('hot ', 1 + int(id % 2)) ELSE concat('t', id) END AS text")
    found = exact_dedup.mark_copies(many).where("doc_id % 3 < 2").selectExpr("text_sha256", "keep_id", "group_size", "kept").distinct().collect()
    assert len({(r["keep_id"], r["group_size"]) for r in found}) == 2


def test_exact_dedup_contents_decide(spark, docs, rows, monkeypatch):
    """Where digests coincide, contents are compared; many equal rows of a hot digest give one that stays."""
    monkeypatch.setattr(exact_dedup, "_digests", lambda body: [F.lit("same").alias("sha"), F.lit(1).alias("second"), F.lit(2).alias("body_len")])
    test_exact_dedup(docs, rows)
    monkeypatch.undo()
    many = spark.range(0, 3000).selectExpr("CASE WHEN id % 3 = 0 THEN 5 END AS doc_id", "'same text' AS text", "id % 2 AS n")
    found = exact_dedup.mark_copies(many)
    assert found.count() == 3000 and [r["doc_id"] for r in found.where("kept").collect()] == [5] and exact_dedup.drop_copies(many).count() == 1


def test_quality(docs, rows):
    found = {r["doc_id"]: r for r in quality.judge(docs).where("doc_id IS NOT NULL").collect()}
    for i, t in rows:
        if i is None:
            continue
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        seen = Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and good.count() == sum(r["kept"] for r in quality.judge(docs).collect())


def test_line_dedup(docs, rows):
    found = {r["doc_id"]: r for r in line_dedup.strip_repeats(docs).where("doc_id IS NOT NULL").collect()}
    seen, want = set(), {}
    for i, t in sorted(dict((i, t) for i, t in rows if i is not None).items()):
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if "".join(w).strip(" "):
                gone |= {k, k + 1, k + 2} if w in seen else set()
                seen.add(w)
        want[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    assert {i: (r["text"], r["n_removed"]) for i, r in found.items()} == want
    assert want[12][1] == 3


def test_mixing(docs, rows):
    found = mixing.mix(docs).collect()
    assert sorted(r["size"] for r in found) == sorted(len(re.findall(r"[^\x20\x09-\x0d]+", t)) for _, t in rows)
    assert all(r["taken"] <= 3 * r["size"] for r in found)
    assert mixing.mix(docs).exceptAll(mixing.mix(docs)).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_mixing_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, None: 3000}
    want, weights = {}, {"a": 5.0, "b": 2.0, "c": 1.0, None: 5.0}
    open_, left = dict(sizes), float(sum(sizes.values()))
    while True:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / total > 3 * sizes[k]]
        if not over:
            want |= {k: left * weights[k] / total for k in open_}
            break
        for k in over:
            want[k] = 3.0 * sizes[k]
            left -= want[k]
            del open_[k]
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert all(math.isclose(got[k], want[k]) for k in want)


def test_mixing_near_target(spark):
    many = spark.range(0, 3000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "repeat('w ', 20 + int(id % 60)) AS text").selectExpr("*", "source AS s")
    found = mixing.mix(many, carry=["s"]).groupBy("s", "target").agg({"taken": "sum"}).collect()
    assert len(found) == 3 and all(abs(r["sum(taken)"] - r["target"]) <= 80 for r in found)


def test_mixing_repeats(spark):
    """Of equal rows at the budget's end only as many are taken as fit, by the operator and by its SQL alike."""
    import duckdb

    rows = [(1, "a", "one two three four five six seven eight nine ten")] * 300 + [(k, "b", "w " * 30) for k in range(2, 400)] + [(500, None, "x y")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.mix(docs).toPandas()
    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql(mixing.ORACLE).df()
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, found[columns].round(6).values.tolist())) == sorted(map(tuple, want[columns].round(6).values.tolist()))
    taken = found[found.doc_id == 1]
    assert abs(taken.taken.sum() - taken.target.iloc[0]) <= 10
    assert mixing.mixed(docs).where("doc_id = 1").count() == taken.copies.sum()


def fingerprint(t):
    words = t.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(fps))]


def test_near_dup(docs, rows):
    found = near_dup.group(docs).collect()
    fps = [fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    least = defaultdict(lambda: math.inf)
    for (i, _), k in zip(rows, roots):
        least[k] = min(least[k], math.inf if i is None else i)
    want = Counter((i, f"{f:016x}", None if least[k] == math.inf else least[k]) for (i, _), f, k in zip(rows, fps, roots))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == want
    assert sum(r["best"] for r in found) == len(set(roots))
    one = near_dup.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len(set(roots))


def test_near_dup_links(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**63))
    fps = {base}
    while len(fps) < 300:  # a dense ball with chains out of it, and some strangers
        f = rng.choice(list(fps))
        for b in rng.integers(0, 64, int(rng.integers(1, 5))):
            f = int(f) ^ (1 << int(b))
        fps.add(int(f) & (2**64 - 1))
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    root = {r["node"]: r["root"] for r in near_dup.components(near_dup.links(nodes)).collect()}
    want = brute_components(fps)
    got = [root.get(f, f) for f in signed]
    assert len({(a, b) for a, b in zip(want, got)}) == len(set(want)) == len(set(got))
    assert near_dup.links(nodes).count() < 15 * len(fps) * 12


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_near_dup_blocks(spark, monkeypatch, blocks):
    """Every number of blocks and hot buckets cut into cells give the same components."""
    monkeypatch.setattr(near_dup, "BLOCKS", ((1 << 63, blocks),))
    monkeypatch.setattr(near_dup, "HOT_BUCKET", 20)
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**63))
    fps = sorted({base} | {base ^ sum(1 << int(b) for b in rng.choice(20, int(rng.integers(1, 7)), replace=False)) for _ in range(200)} | {int(x) for x in rng.integers(0, 2**63, 100)})
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    root = {r["node"]: r["root"] for r in near_dup.components(near_dup.links(nodes)).collect()}
    got = [root.get(f, f) for f in signed]
    assert len(set(zip(brute_components(fps), got))) == len(set(brute_components(fps))) == len(set(got))


def test_pieces(docs, rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    count = Counter((r["doc_id"], r["n_tokens"], r["n_bytes"], r["over_limit"]) for r in tokens.count(docs).collect())
    ids = [lib.encode(t) for _, t in rows]
    assert count == Counter((i, len(x), len(t.encode()), len(x) > 4096) for (i, t), x in zip(rows, ids))
    encoded = tokens.encode(docs, carry=["salt"])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == Counter((i, tuple(x)) for (i, _), x in zip(rows, ids))
    assert encoded.where("NOT round_trip").count() == 0
    assert Counter(r["text"] for r in tokens.decode(encoded).collect()) == Counter(lib.decode(x) for x in ids)


ODD = ("implementation  of it", "--------=====", "x" * 500, "日本語𠮷 \x00 é", "a     b", "thththeredonble", "", " ", "\n\n x\n", "▁a▁", "tab\there " * 9, "=" * 77 + " " * 33 + "-" * 41, "é" * 90)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())


@pytest.mark.parametrize("size", [1, 3, 17, 1000])
def test_piece_stream(library, size):
    """Ids come out of the stream as from the library, however it is cut, and before the end of a long text."""
    model = pieces.pieces(tokens.model_path())
    for t in ODD:
        whole = model.spelled(t)
        assert list(model.stream(whole[k : k + size] for k in range(0, len(whole), size))) == library.encode(t)
    given, out = [], model.stream(given.append(k) or "some words and more " for k in range(10_000))
    assert next(out) and len(given) < 50


@pytest.mark.parametrize("chunk", [1, 3, 17, 1000])
def test_piece_counts(library, chunk):
    """Counts of composed maps; composition in any grouping."""
    counter = pieces.Counter(pieces.pieces(tokens.model_path()))
    for t in (*ODD, PROSE, "ab" * 3000):
        assert counter.count(t, chunk) == len(library.encode(t))
    whole = counter.model.spelled(PROSE + "  x\n" + PROSE)
    maps = [counter.stretch(whole[k : k + chunk]) for k in range(0, len(whole), chunk)]
    left = right = None
    for m in maps:
        left = m if left is None else counter.compose(left, m)
    for m in reversed(maps):
        right = m if right is None else counter.compose(m, right)
    assert left == right == counter.scan(maps)[-1]
    assert [counter.total(m) for m in counter.scan(maps)] == [len(library.encode(whole[1 : k + chunk].replace(pieces.SPACE, " "))) if k + chunk > 1 else counter.total(maps[0]) for k in range(0, len(whole), chunk)]


def test_pieces_forget(library, monkeypatch):
    """What a worker remembers is bounded; results stay."""
    monkeypatch.setattr(pieces, "MAX_TRANSITIONS", 50)
    monkeypatch.setattr(pieces, "MAX_WORDS", 3)
    counter, encoded = pieces.Counter(pieces.pieces(tokens.model_path())), pieces.Encoded(pieces.pieces(tokens.model_path()))
    for t in (*ODD, PROSE):
        assert counter.count(t, 7) == len(library.encode(t)) and [i for r in encoded.of(t) for i in r] == library.encode(t)
        assert len(counter.words) <= 3 and len(encoded) <= 3 and counter.known <= 110


def test_ctw_base(docs, rows):
    found = ctw.score(docs, block_bytes=20_000).collect()
    assert len(found) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: [*t.encode().lower().split(), None]
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), 4)) for i, t in rows)
    assert want == sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in found)
    assert {r["train_tokens"] for r in found} == {n} and all(r["score"] < 0 for r in found)


@pytest.mark.parametrize("size", [1, 7, 50])
def test_ctw_slices(monkeypatch, size):
    """Trees weighed slice by slice are the trees weighed at once."""
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(0, 2**64, 200, dtype=np.uint64), (np.uint64(7) << np.uint64(8 * (ctw.DEPTH - 1))) + np.arange(90, dtype=np.uint64)]))
    keys = np.unique(keys & np.uint64((1 << 8 * (ctw.DEPTH + 1)) - 1))
    counts = rng.integers(0, 9, len(keys))
    whole = ctw.Subtrees(keys, counts)
    monkeypatch.setattr(ctw, "_SLICE", size)
    parts = list(ctw._trees(keys, counts, ctw.DEPTH))
    assert len(parts) > 1 and np.array_equal(np.concatenate([p.entries[ctw.DEPTH] for p in parts]), keys)
    top = ctw.Top(*[np.concatenate(x) for x in zip(*[whole.upper(bit) for bit in range(8)])])
    assert np.allclose(np.concatenate([p.log10(top) for p in parts]), whole.log10(top))


def test_ctw_against_recursion(spark):
    """The mixture of all depths, by definition, on a few short texts."""
    texts = ["the cat sat on the mat", "the cat ate", "a dog sat on a log", "on the mat", "dogs and cats", "that cat"]
    got = {r["doc_id"]: r for r in ctw.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block_bytes=40).collect()}
    depth = ctw.DEPTH
    spelled = [b"\n" * depth + t.encode() + b"\n" for t in texts]
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    steps = lambda q: ((q[:k], (1 << j) | (q[k] >> (8 - j)), q[k] >> (7 - j) & 1) for k in range(depth, len(q)) for j in range(8))
    for i, q in enumerate(spelled):
        if not got[i]["held_out"]:
            for before, node, bit in steps(q):
                for d in range(depth + 1):
                    counts[before[len(before) - d :], node][bit] += 1
                    if d:
                        children[before[len(before) - d + 1 :] if d > 1 else b"", node].add(before[len(before) - d :])
    own = lambda c: math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(c) + 1)

    def weighted(context, node):
        e = own(counts[context, node])
        if len(context) == depth:
            return e
        return math.log(0.5) + float(np.logaddexp(e, sum(weighted(c, node) for c in children[context, node])))

    for i, q in enumerate(spelled):
        total = 0.0
        for before, node, bit in steps(q):
            mixed, rest = 0.0, 1.0
            for d in range(depth + 1):
                context = before[len(before) - d :]
                if (context, node) not in counts:
                    mixed += rest / 2
                    break
                z, o = counts[context, node]
                w = math.exp(math.log(0.5) + own((z, o)) - weighted(context, node)) if d < depth else 1.0
                mixed, rest = mixed + rest * w * (o + 0.5) / (z + o + 1), rest * (1 - w)
            total += math.log10(mixed if bit else 1 - mixed)
        assert math.isclose(total, got[i]["score"], rel_tol=1e-4)


def test_ctw_learns(spark):
    """Held-out prose of a corpus scores better than under unigrams."""
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{a}" for a in "bdfgkl" for b in "aeiou"]  # each is followed by one of two others

    def prose():
        at, out = 0, []
        for step in rng.integers(0, 2, 200):
            at = (7 * at + 3 + int(step)) % len(words)
            out.append(words[at])
        return " ".join(out)

    rows = [(k, prose()) for k in range(100)]
    out = ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"]


def test_url_rules(spark):
    urls = [
        "http://x.example.com/en/1", "https://example.com/en/71?q#f", "https://EXAMPLE.com/en/8", "http://badexample.com/en/7", "http://a.net/de/8", "http://b.example.net/de/8x", "http://a.org/es/",
        "http://casino-win.example.org/a", "http://a.org/x?u=com/en/", "no scheme", None, "://", "http://com/en/", "http://x.com/EN/1", "http://x.com/en",
    ]
    got = {r["page_id"]: r for r in url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[k]["rule"] for k in range(15)] == ["com/en/", "example.com/en/7", "com/en/", "com/en/", "net/de/", "example.net/de/8", "org/es/", None, None, None, None, None, "com/en/", None, None]
    assert [got[k]["verdict"] for k in range(9)] == ["block", "allow", "block", "block", "allow", "block", "block", "block", "allow"]
    index = url_rules.Index(list(url_rules.SITES + url_rules.JUNK), {"com": 9, "en": 5, "example": 1})
    assert index.by_token["example"] and all(len(index.candidates(u or "")) <= len(index.rules) for u in urls)


def test_url_rules_in_a_table(spark, monkeypatch):
    """The join of many rules gives what the index gives, and what trying every rule on every URL gives."""
    import random

    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "shop", "news", "x1"]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    patterns = [rng.choice(["||{}.{}^", "^{}^{}^", "/{}*{}", "*{}-{}", "||{}.com/{}"]).format(*pick(2)) for _ in range(60)] + ["*", "^7^"]
    rules = tuple(url_rules.Rule(p, rng.choice(["block", "allow"]), rng.choice([None, None, p.strip("|")])) for p in dict.fromkeys(patterns) if p != "*")
    urls = [f"http://{'.'.join(pick(2))}.{rng.choice(['com', 'COM', 'org'])}/{'/'.join(pick(3))}{rng.choice(['', '?q=' + words[0], '/7'])}" for _ in range(300)]
    urls += [None, "", "://", urls[0], "http://shop.com/" + "a/" * 50_000 + "alpha-beta"] + urls[:20]
    pages = spark.createDataFrame([(k, u, "clash", 3) for k, u in enumerate(urls)], "page_id long, url string, token string, salt int")

    def brute(url):
        host, path = url_rules.parts(url)
        fits = [r for r in rules if re.search(url_rules.expression(r.pattern), host + path, re.S)]
        named = sorted((r for r in fits if r.name), key=lambda r: (-len(r.name), r.verdict != "block", r.name))
        kinds = {r.verdict for r in fits}
        return (host, path, named[0].name, named[0].verdict) if named else (host, path, None, "block" if kinds == {"block"} else "allow")

    want = {k: brute(u) for k, u in enumerate(urls)}
    assert len({w[2:] for w in want.values()}) > 5
    table_of_rules = spark.createDataFrame([(r.pattern, r.verdict, r.name) for r in rules], "pattern string, verdict string, name string")
    assert {r[0]: tuple(r[1:]) for r in url_rules.judge(pages, rules).collect()} == want
    assert {r[0]: tuple(r[1:]) for r in url_rules.judge(pages, table_of_rules).collect()} == want
    monkeypatch.setattr(url_rules, "MAX_RULES", 5)
    assert {r[0]: tuple(r[1:]) for r in url_rules.judge(pages, rules).collect()} == want
    monkeypatch.setattr(url_rules, "hot_values", lambda rows, column: ["shop", "alpha", "", "alpha.beta.com"])
    assert {r[0]: tuple(r[1:]) for r in url_rules.judge(pages, table_of_rules).collect()} == want


def test_tokens_without_spaces():
    """Long texts without spaces take time in proportion, and give the library's ids and counts."""
    rng = random.Random(12)
    library = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    model = pieces.pieces(tokens.model_path())
    for alphabet, size in (("abcdefghijklmnopqrstuvwxyz", 150_000), ("".join(map(chr, range(0x4E00, 0x4E00 + 3000))), 150_000), ("a", 100_000), ("é日x\u2581\U0001f600", 50_000)):
        text = "".join(rng.choice(alphabet) for _ in range(size))
        want = library.encode(text)
        assert [i for run in pieces.Encoded(model).of(text) for i in run] == want
        assert pieces.Counter(model).count(text, 4096) == len(want)


def test_empty_tables(spark):
    none = table(spark, [], ids=[])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        exact_dedup.mark_copies(none), exact_dedup.drop_copies(none), quality.keep_good(none), line_dedup.strip_repeats(none), mixing.mix(none), near_dup.group(none), tokens.count(none), tokens.encode(none),
        ctw.score(none), html_text.main_text(pages), url_rules.judge(pages),
    ):
        assert out.count() == 0
