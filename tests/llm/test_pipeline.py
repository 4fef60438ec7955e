"""The pipeline against a plain version of its filtering stages, on the smallest tables."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    from textward.llm import mixing, quality
    from textward.llm.common import table, written

    docs = table(spark, DATA, "documents")
    columns = docs.columns
    sizes = [docs.count()]
    kept = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = written(stage(spark, before, DATA), name)
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        sizes.append(len(kept[name]))
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality_rules":
            assert sorted(kept[name]) == sorted(r["doc_id"] for r in quality.judge(before).collect() if r["kept"])
        if name == "exact_dedup":
            assert docs.selectExpr("regexp_replace(text, '[ \\\\t\\\\n\\\\x0b\\\\f\\\\r]', '') t").distinct().count() == sizes[-1]
        if name == "mix_sources":
            want = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["copies"] > 0}
            assert {i: kept[name].count(i) for i in set(kept[name])} == want
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0 and sizes[4] == sizes[5]
    assert pipeline.run(spark, DATA).count() == sizes[-1]


def test_near_copies_go(spark):
    """Of planted near copies (real Jaccard of five-word shingles 0.8 to 1) one of each component stays, and nothing else goes."""
    import random

    rng = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    texts = []
    for k in range(200):
        base = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(base))
        for _ in range(k % 4):
            copy = list(base)
            for _ in range(max(1, len(copy) // rng.choice((45, 60, 30)))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    pairs = [(a, b) for b in range(len(texts)) for a in range(max(0, b - 4), b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in pairs:
        root = [root[a] if r == root[b] else r for r in root] if root[a] < root[b] else [root[b] if r == root[a] else r for r in root]
    assert len(pairs) > 100 and len(set(root)) > 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stage = pipeline.STAGES[2][1]
    assert sorted(r["doc_id"] for r in stage(spark, docs, DATA).collect()) == sorted(set(root))


def test_large_group_of_near_copies(spark, monkeypatch):
    """A bucket cut into blocks loses no link; blank texts are alike, and texts of fewer than five words differ by words."""
    import random

    from textward.llm import similar

    monkeypatch.setattr(similar, "HOT_BUCKET", 20)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(150):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(copy)))
    rows += [(200, None), (201, " \n"), (202, "one two"), (203, "One  two"), (204, "one three"), (None, "no id")]
    found = {r["doc_id"]: r["component_id"] for r in similar.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: 0 for k in range(150)} | {200: 200, 201: 200, 202: 202, 203: 202, 204: 204, None: None}


def test_empty_stages(spark):
    """An empty table passes through all stages; columns with clashing names come through."""
    from textward.llm import mixing, similar, tokens

    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, salt int, in_0 string, fp long, best boolean")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, none, DATA)
        assert out.columns == none.columns and out.count() == 0, name
    assert pipeline.STAGES[-1][1](spark, none, DATA).count() == 0
    assert mixing.mixed(none).count() == similar.one_of_each(none).count() == tokens.decode(tokens.encode(none)).count() == 0
    rows = none.union(spark.createDataFrame([(1, "a b c", "en", None, 5, 7, "z", 9, True), (None, None, None, None, None, None, None, None, None), (1, "a b c", "en", None, 5, 7, "z", 9, True)], none.schema))
    assert similar.one_of_each(rows).orderBy("doc_id").collect()[1] == rows.where("doc_id = 1").first() and similar.one_of_each(rows).count() == 2


def test_near_copies_by_fingerprint(spark):
    """Texts whose SimHashes lie within near_dup's bits meet through its links alone, without any MinHash band; a link is verified by the sets."""
    import random

    from textward.llm import near_dup, similar

    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(1500)]
    rows = [(0, " ".join(base)), (3, "a b c d e f g"), (4, "")]
    for k in (1, 2):
        copy = list(base)
        copy[700 * k] = "changed"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["component_id"] for r in near_dup.group(docs).collect()}
    assert want == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    bare = similar.shingle_sets(docs).selectExpr("doc_id", "fp", "sim", "grams", "CAST(array() AS array<long>) keys")
    names = {r["fp"]: r["doc_id"] for r in bare.collect()}
    linked = {frozenset((names[r["u"]], names[r["v"]])) for r in similar.links(bare).collect()}
    assert linked and set().union(*linked) == {0, 1, 2}
