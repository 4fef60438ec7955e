"""Library operators: oracles on the smallest tables, planted rows, streams."""

import json
import math
import random
import time
from collections import Counter
from datetime import datetime, timezone

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textward.functions import features, rules, text
from textward.operators import augment, cascade, corpus, metrics, mining, models, prefix, relational, rule_table, windows
from textward.plans import registry
from textward.plans.base import LATIN
from textward.sources import tables
from textward.streaming import intake, jobs

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["x08_normalise", "x12_process_spam", "x17_char_ngrams", "f07_repeated_chars_ratio", "f14_weird_char_ratio", "c11_moderate", "j03_split_batches", "j08_transitions", "d04_stratified_split", "a05_pr_curve", "a09_roc_auc", "r06_subsets", "w02_peak_concurrency", "w03_micro_batches", "c01_rule_table", "m02_tfidf"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()[list(got.columns)]
    order = lambda f: sorted(tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in f.astype(object).itertuples(index=False))
    numbers = [c for c in got.columns if got[c].dtype.kind in "if" or want[c].dtype.kind in "if"]
    for c in numbers:
        got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert order(got) == order(want)


def values(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, text string").orderBy("k").select(*columns).collect()]


def test_normalise_planted(spark):
    t = F.col("text")
    rows = [None, "  ", "http://a.b/c<br>Да", "a@b.ru x", "[id12|Имя], привет", "&lt; a; b", "ЁЖ  ёж", "a\x1cb"]
    got = [r[0] for r in values(spark, rows, text.normalise(t))]
    assert got[:2] == ["", ""] and got[2] == "да" and got[3] == "x" and got[4] == "привет" and got[5] == "b" and got[6] == "ёж ёж"
    assert [r[0] for r in values(spark, ["И не Я", "x"], text.process_spam(t))] == ["", "x"]


def test_cyrillic_rules(spark):
    t = F.col("text")
    got = [r[0] for r in values(spark, ["идиот", "ИДИОТ!", "хорошо", None, "халтура"], rules.names(rules.categories(t, rules.TOXIC)))]
    assert got == ["бля", "бля", "", "", ""]
    assert values(spark, ["ХАЛТУРА"], rules.any_hit(t, rules.SPAM)) == [(True,)]


def test_capitals_and_phones(spark):
    t = F.col("text")
    rows = ["СКИДКА!!", "СКИД!!", "СКИДКА !!", "ПОДАРОК", "ПОДАРО", "8 (900) 123-45-67", "123456789", "1234567890123456"]
    assert [r[0] for r in values(spark, rows, features.matches_caps_shout(t))] == [True, False, True, False, False, False, False, False]
    assert [r[0] for r in values(spark, rows, features.matches_caps_word(t))] == [False, False, False, True, False, False, False, False]
    assert [r[0] for r in values(spark, rows, features.feature("has_phone", t))] == [0, 0, 0, 0, 0, 1, 0, 0]
    with pytest.raises(ValueError):
        features.features(t, ["nonsense"])


def test_char_ngrams(spark):
    def model(word, least, most):
        padded, out = f" {word} ", []
        for n in range(least, most + 1):
            if n >= len(padded):
                out.append(padded)
                break
            out += [padded[k : k + n] for k in range(len(padded) - n + 1)]
        return out

    words = ["", "a", "ab", "abc", "abcd", "abcde", "ab  abc"]
    got = [r[0] for r in values(spark, words, text.char_ngrams(F.col("text"), 3, 5))]
    assert [sorted(g) for g in got] == [sorted(x for w in t.split() for x in model(w, 3, 5)) for t in words]


def test_modes_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "  "), (3, "thth"), (4, "СКИДКА!!")], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in cascade.classify(df, toxic=LATIN).collect()}
    assert rows[1]["tox_model_used"] is None and rows[2]["tox_model_used"] == "regex" and rows[2]["toxicity_score"] == 0.0 and rows[3]["tox_model_used"] == "regex" and rows[3]["is_toxic"]
    assert rows[4]["spam_score"] == 0.0  # without a model there is no stage two
    assert {r["spam_model_used"] for r in cascade.classify(df, "tox_only", LATIN).collect()} == {None}
    with pytest.raises(ValueError):
        corpus.require(df, ["nothing"])


def test_cascade_uses_the_model(spark):
    """Rule hits skip the model, misses get its score, each different text once; capitals decide on the spam side."""
    labelled = [(k, "good fine text here" if k % 2 else "bad awful junk there", 1 - k % 2) for k in range(20)]
    tox = models.fit_bayes(spark.createDataFrame(labelled, "doc_id long, text string, label int"))
    junk = models.fit_bayes(spark.createDataFrame(labelled, "doc_id long, text string, label int"), "spam")
    df = spark.createDataFrame([(1, "awful junk"), (1, "awful junk"), (2, "fine text"), (3, "thth fine"), (4, ""), (5, " "), (6, "zzz qqq"), (7, "ПОДАРОК")], "doc_id long, text string")
    rows = cascade.classify(df, toxic=LATIN, tox_model=tox, spam_model=junk).collect()
    assert len(rows) == 8
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["is_toxic"] and by[1]["is_spam"] and by[1]["tox_model_used"] == "tfidf" and not by[2]["is_toxic"] and by[2]["tox_model_used"] == "tfidf"
    assert (by[3]["tox_model_used"], by[3]["toxicity_score"], by[4]["tox_model_used"], by[5]["toxicity_score"]) == ("regex", 1.0, None, 0.0)
    assert by[6]["toxicity_score"] == 0.5 and by[7]["spam_score"] == 1.0 and by[7]["spam_model_used"] == "tfidf"


def test_tfidf_by_hand(spark):
    """Vectors and complement Bayes against a plain computation."""
    texts = ["aa bb aa", "bb cc", "cc aa dd", "dd", "aa bb"]
    labels = [1, 0, 1, 0, 0]
    frame = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(zip(texts, labels))], "doc_id long, text string, label int")

    def grams(t):
        out = {}
        for w in t.split():
            p = f" {w} "
            for n in (3, 4):
                for k in range(len(p) - n + 1):
                    out[p[k : k + n]] = out.get(p[k : k + n], 0) + 1
        return out

    tf = [grams(t) for t in texts]
    df = {g: sum(g in d for d in tf) for d in tf for g in d}
    idf = {g: math.log((1 + len(texts)) / (1 + n)) + 1 for g, n in df.items() if n >= 2}
    vectors = []
    for d in tf:
        w = {g: (1 + math.log(n)) * idf[g] for g, n in d.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vectors.append({g: x / norm for g, x in w.items()})
    share = {}
    for y in (0, 1):
        total = {g: sum(v.get(g, 0.0) for v, own in zip(vectors, labels) if own == y) for g in idf}
        share[y] = {g: math.log((x + 1) / (sum(total.values()) + len(idf))) for g, x in total.items()}
    want = [1 / (1 + math.exp(-sum(x * (share[1][g] - share[0][g]) for g, x in v.items()))) for v in vectors]
    got = {r["doc_id"]: r["score"] for r in models.score(models.fit_bayes(frame), frame).collect()}
    assert [got[k] for k in range(5)] == pytest.approx(want, abs=1e-6)
    counted = models._counted(frame, "doc_id", "toxicity", (3, 4), [])
    kept, terms, _ = models._training(*counted, "doc_id", [], 100, 2, 1.0, True, True, "l2")
    index = {r["idx"]: r["term"] for r in terms.collect()}
    rows = sorted(sorted((index[int(i)], round(float(x), 6)) for i, x in zip(r["features"].indices, r["features"].values)) for r in kept.collect())
    assert rows == sorted(sorted((g, round(x, 6)) for g, x in v.items()) for v in vectors)


def test_spam_model_features(spark):
    """Hand-made features take part, capitals rows are not learnt from, and decide with score 1."""
    rows = [(k, "one two three" + ("!!!!!! ???" if k % 2 else ""), k % 2) for k in range(20)] + [(50, "СКИДКА!! one two three", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = models.fit(frame, "spam")
    assert [x[0] for x in model.extra] == features.NAMES and [x[0] for x in models.fit(frame, "spam", names=["space_ratio", "length_chars_log1p"]).extra] == features.MINIMAL
    got = {r["doc_id"]: r for r in models.score(model, frame).collect()}
    assert got[1]["decided"] and not got[0]["decided"] and got[50]["score"] == 1.0
    assert {r["part"] for r in models.importance(model).collect()} == {"all", "feature"}


def test_search(spark):
    rows = [(k, "good fine text here" if k % 2 else "bad awful junk there", k % 2) for k in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    found = models.search(frame, [{"size": 50}], folds=2, by="f1").collect() + models.search(frame.where("doc_id < 8"), [{"c": 0.5}], val=frame.where("doc_id >= 8")).collect()
    assert [r["objective"] for r in found] == [1.0, 1.0]


WEIGHTS = [{}, {"norm": "l1", "alpha": 0.5}, {"use_idf": False, "sublinear": False, "size": 40}, {"min_df": 3, "max_df": 0.8, "sublinear": False, "norm": "l1"}]


def test_search_bayes(spark):
    """One pass over all trials and folds gives what fitting each of them gives, with every kind of weight."""
    rng = random.Random(11)
    words = ["good", "fine", "text", "here", "bad", "awful", "junk", "there", "СКИДКА!!"]
    rows = [(k, " ".join(rng.choice(words[:6] if k % 3 else words[2:]) for _ in range(rng.randint(1, 9))) if k % 11 else " ", int(k % 3 == 0)) for k in range(45)]
    frame = spark.createDataFrame([*rows, (99, "none", None)], "doc_id long, text string, label int")
    held, folds = models._dealt(frame, 2, None, "doc_id")
    got = {(r["trial"], r["fold"]): r["objective"] for r in models._bayes_curves(held, folds, list(enumerate({"alpha": 1.0, "size": 100, "sizes": (3, 4), "min_df": 2, "max_df": 1.0, "sublinear": True, "use_idf": True, "norm": "l2"} | w for w in WEIGHTS)), (3, 4), "ap", 0.9, "doc_id", "spam").collect()}
    for i, w in enumerate(WEIGHTS):
        for k in folds:
            model = models.fit_bayes(held.where(f"fold <> {k}"), "spam", **({"size": 100} | w))
            points = metrics.curve(models.scored(model, held.where(f"fold = {k}")).select(F.round("score", 6).alias("score"), "label"))
            assert got[i, k] == pytest.approx(metrics.average_precision(points).first()[0], abs=1e-6)
    found = models.search_bayes(frame, [{"alpha": 0.5}, {"sizes": (2, 3)}], folds=2, floor=0.5).collect()
    assert sorted(r["trial"] for r in found) == [0, 1] and all(0 < r["objective"] <= 1 for r in found)


def test_vocabulary_by_buckets(spark):
    """Large buckets first: the same commonest terms as counting all, also where the bound fails and smaller buckets join in."""
    rng = random.Random(13)
    rows = [(d, "all" if d % 2 else "caps", f"t{int(rng.paretovariate(0.7)) % 700}", rng.randint(1, 5)) for d in range(300) for _ in range(12)]
    tf = spark.createDataFrame(sorted({(d, p, g): n for d, p, g, n in rows}.items()), "k struct<doc_id:int,part:string,term:string>, tf int").select("k.*", "tf").cache()
    for size, min_df, max_df, buckets in ((10, 1, 1.0, 64), (50, 2, 0.3, 64), (50, 5, 0.2, 8), (5000, 1, 1.0, 1024), (40, 2, 1.0, 1 << 18)):
        want = [tuple(r) for r in models.vocabulary(tf, 300, size, min_df, max_df).collect()]
        assert [tuple(r) for r in models.vocabulary(tf, 300, size, min_df, max_df, buckets).collect()] == want
        assert want


def test_weight_parameters(spark):
    """Raw counts, no idf and the l1 norm, against the definition; a saved model keeps them."""
    texts, labels = ["aab", "aab aab ccd", "ccd", "ccd aab", "xyz ccd"], [1, 1, 0, 1, 0]
    frame = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(zip(texts, labels))], "doc_id long, text string, label int")
    model = models.fit_bayes(frame, sublinear=False, use_idf=False, norm="l1")
    tf = [Counter(g for w in t.split() for n in (3, 4) for g in [f" {w} "[a : a + n] for a in range(len(w) + 3 - n)]) for t in texts]
    known = {g for g in set().union(*tf) if sum(g in d for d in tf) >= 2}
    vectors = [{g: n / sum(x for h, x in d.items() if h in known) for g, n in d.items() if g in known} for d in tf]
    share = {}
    for y in (0, 1):
        total = {g: sum(v.get(g, 0.0) for v, own in zip(vectors, labels) if own == y) for g in known}
        share[y] = {g: math.log((x + 1) / (sum(total.values()) + len(known))) for g, x in total.items()}
    want = [1 / (1 + math.exp(-sum(x * (share[1][g] - share[0][g]) for g, x in v.items()))) for v in vectors]
    got = {r["doc_id"]: r["score"] for r in models.score(model, frame).collect()}
    assert [got[k] for k in range(5)] == pytest.approx(want, abs=1e-6)
    kept, _, _ = models._training(*models._counted(frame, "doc_id", "toxicity", (3, 4), []), "doc_id", [], 100, 2, 1.0, False, False, "l1")
    assert all(abs(sum(r["features"].values) - 1) < 1e-9 for r in kept.collect())
    with pytest.raises(ValueError):
        models.norm_of(F.col("w"), "l3")


def test_prefix_sum(spark):
    df = spark.range(0, 1000).selectExpr("cast(id AS double) AS x", "id % 7 AS v")
    got = {r["x"]: r["run_v"] for r in prefix.prefix_sum(df, "x", ["v"], 8).collect()}
    assert all(got[float(k)] == sum(i % 7 for i in range(k, 1000)) for k in range(0, 1000, 37))


def test_micro_batches(spark, monkeypatch):
    rows = [("a", float(t), k) for k, t in enumerate([0, 1, 2, 3, 10, 30, 31, 45])]
    got = windows.micro_batches(spark.createDataFrame(rows, "s string, at double, id long"), "s", "at", "id", 3, 15.0)
    assert [r["batch"] for r in got.orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, 2, 2]  # the late one closes its batch
    rng = random.Random(3)
    rows = [(s, round(rng.random() * 60, 1), k) for k, s in enumerate(["a"] * 260 + ["b"] * 9 + ["c"] + [None] * 30)]
    want, state = {}, {}
    for s, at, k in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        n, first, batch = state.get(s, (0, 0, 0))
        first = at if n == 0 else first
        want[k] = batch
        closed = n + 1 >= 4 or round(at - first, 6) >= 0.5
        state[s] = (0, 0, batch + 1) if closed else (n + 1, first, batch)
    monkeypatch.setattr(windows, "FAN", 3)
    df = spark.createDataFrame(rows, "s string, at double, id long")
    assert {r["id"]: r["batch"] for r in windows.micro_batches(df, "s", "at", "id", 4, 0.5, block=6).collect()} == want


def test_peak_concurrency(spark):
    rng = random.Random(2)
    rows = [(g, a, a + rng.randint(0, 9)) for g in "abc" for a in [rng.randint(0, 300) for _ in range(200)]]
    want = {}
    for g in "abc":
        moves = sorted([(a, 1) for k, a, _ in rows if k == g] + [(b, -1) for k, _, b in rows if k == g])
        open_now = 0
        want[g] = 0
        for _, d in sorted(moves):
            open_now += d
            want[g] = max(want[g], open_now)
    got = windows.peak_concurrency(spark.createDataFrame(rows, "g string, a int, b int"), "g", "a", "b")
    assert {r["g"]: r["peak"] for r in got.collect()} == want


def _edges(values):
    out = []
    for q in (0.25, 0.5, 0.75):
        e = round(float(np.quantile(values, q)))
        out.append(max(e, out[-1] + 1) if out else e)
    return out


def test_percentiles_selected(spark):
    """Ranges are refined down to few rows: heavy tails, ties, single rows; and a sketch stays within its rank error."""
    rng = np.random.default_rng(1)
    values = {"tail": np.exp(rng.normal(0, 4, 3000)), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([7.0]), "two": np.array([-1.0, 2.0]), "same": np.full(90, 5.0)}
    df = spark.createDataFrame([(g, float(v)) for g, own in values.items() for v in own] + [("tail", None)], "g string, v double")
    got = {(r["g"], r["share"]): r["value"] for r in metrics.selected(df, ["g"], F.col("v"), bins=8, small=20).collect()}
    assert got == {(g, p): pytest.approx(np.quantile(own, p)) for g, own in values.items() for p in metrics.SHARES}
    exact = {r["g"]: r for r in metrics.percentile_table(df, ["g"], F.col("v")).collect()}
    plain = {r["g"]: r for r in df.groupBy("g").agg(*metrics.percentiles(F.col("v"))).collect()}
    assert {g: tuple(r) for g, r in exact.items()} == {g: tuple(r) for g, r in plain.items()}
    rough = {r["g"]: r for r in df.groupBy("g").agg(*metrics.percentiles(F.col("v"), k=2000)).collect()}
    for p in metrics.SHARES:
        assert abs((values["tail"] <= rough["tail"][metrics.share_name(p)]).mean() - p) < 0.005
    assert windows.quantile_edges(df.where("g = 'ties'"), "v", 4) == _edges(values["ties"])


def test_noise(spark):
    df = spark.range(0, 40).selectExpr("id AS doc_id", "repeat('привет всем ', 5) AS text", "cast(id % 2 AS int) AS label")
    for kind, sign in (("insert", 1), ("delete", -1), ("replace", 0), ("qwerty", 0), ("leet", 0)):
        one, two = augment.noise(df, kind), augment.noise(df.repartition(7), kind)
        assert one.exceptAll(two).count() == 0
        assert {(len(r["text"]) > 60) - (len(r["text"]) < 60) for r in one.collect()} == {sign}
    out = augment.dataset(df.union(df))
    assert out.where("kind = 'original'").count() == 80 and out.where("kind <> 'original' AND text = repeat('привет всем ', 5)").count() == 0
    assert out.where("kind <> 'original'").groupBy("doc_id").count().where("count <> 2").count() == 0  # repeated rows do not multiply


def test_noise_rules():
    import random

    rng = random.Random(1)
    texts = [("Привет МИР и все", k) for k in range(300)]
    for t, _ in texts:
        made, name = augment.apply("qwerty", t, 0.2, rng)
        moved = [(a, b) for a, b in zip(t, made) if a != b]
        assert name == "char_noise_qwerty" and len(moved) <= 3 and all(b.lower() in augment.NEAR[a.lower()] and a.isupper() == b.isupper() for a, b in moved)
        assert len(augment.apply("insert", t, 0.2, rng)[0]) == len(t) + 3 and len(augment.apply("delete", t, 0.2, rng)[0]) == len(t) - 3
        assert all(b in augment.LEET.get(a.lower(), "").upper() + augment.LEET.get(a.lower(), "") for a, b in zip(t, augment.apply("leet", t, 0.5, rng)[0]) if a != b)
        assert augment.apply("combined", t, 0.1, rng)[1] == "char_noise_combined"
    assert augment.apply("delete", "я", 1.0, rng)[0] == "я" and augment.apply(None, "  ", 1.0, rng) == ("  ", "original")
    kinds = {augment.apply(None, t, 0.1, rng)[1] for t, _ in texts}
    assert kinds == {f"char_noise_{k}" for k in ("qwerty", "insert", "delete", "replace")}  # the shares leave nothing to the rest
    assert {augment.apply(None, t, 0.1, rng, shares={"qwerty": 0.1, "leet": 0.2})[1] for t, _ in texts} == {"char_noise_qwerty", "char_noise_leet", "char_noise_combined"}


def test_dataset_intensity(spark):
    """Positives get more noise, up to a tenth of their length."""
    df = spark.range(0, 200).selectExpr("id AS doc_id", "repeat('слово ', 50) AS text", "cast(id % 2 AS int) AS label")
    sizes = {}
    for r in augment.dataset(df, p=1.0, more=4.0, intensity=0.02).where("kind = 'char_noise_insert'").collect():
        sizes.setdefault(r["label"], set()).add(len(r["text"]) - 300)
    assert sizes == {0: {6}, 1: {24}}


def test_model_round_trip(spark, tmp_path):
    rows = [(k, "good fine text here" if k % 2 else "bad awful junk there", k % 2) for k in range(20)]
    df = spark.createDataFrame([*rows, (99, "", 0)], "doc_id long, text string, label int")
    model = models.with_threshold(models.fit(df, size=100), df)
    models.save(model, str(tmp_path), note="x")
    again, metadata = models.load(spark, str(tmp_path))
    scores = {r["doc_id"]: r for r in models.score(again, df).collect()}
    assert metadata["note"] == "x" and again.threshold == model.threshold != 0.5 and scores[1]["decided"] and not scores[0]["decided"] and scores[99]["score"] == 0.0


@pytest.fixture
def one_state(spark):
    """Streams of a few rows keep their state in one partition."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def _send(folder, name, task, texts, at="2024-01-01T00:00:00Z"):
    items = [{"text": t, "ref": {"chat_id": 7, "message_id": k}} for k, t in enumerate(texts)]
    (folder / f"{name}.json").write_text(json.dumps({"task_id": task, "source": "telegram", "items": items, "sent_at": at}))


def test_stream(spark, one_state, tmp_path):
    """Items are judged, saved by key and sent back with their refs; a later batch finds its texts in the cache; failures are told."""
    given, out = tmp_path / "in", str(tmp_path / "out")
    given.mkdir()
    run = lambda mode="both": jobs.moderate(jobs.requests(spark, str(given)), out, str(tmp_path / "c"), mode, toxic=LATIN).awaitTermination(120)
    _send(given, "a", "t", ["ththe", "fine words", "", "fine words", "БЕСПЛАТНО!!", "бесплатно!!", "   "])
    run()
    items = lambda: {(r["task_id"], r["item_index"]): r for r in jobs.saved_items(spark, out).collect()}
    got = items()
    assert [got["t", k]["is_toxic"] for k in range(4)] == [True, False, False, False] and not any(r["from_cache"] for r in got.values())
    judged = {r["text"]: r for r in cascade.classify(spark.createDataFrame([(k, t) for k, t in enumerate(["", "   ", "БЕСПЛАТНО!!", "бесплатно!!"])], "doc_id int, text string"), toxic=LATIN).collect()}
    for k, t in ((2, ""), (4, "БЕСПЛАТНО!!"), (5, "бесплатно!!"), (6, "   ")):
        assert [got["t", k][c] for c in jobs.VERDICT] == [judged[t][c] for c in jobs.VERDICT]
    listed = json.loads(spark.read.json(f"{out}/results").first()["results"])
    assert [x["ref"]["message_id"] for x in listed] == list(range(7))
    _send(given, "b", "u", ["Fine words ", "new words", " "])
    run()
    got = items()
    assert [got["u", k]["from_cache"] for k in range(3)] == [True, False, False] and len(got) == 10
    flagged = jobs.actions(jobs.saved_items(spark, out).where("text = 'ththe'"))
    assert [tuple(r) for r in flagged.collect()] == [(7, 0, "delete")]
    _send(given, "c", "v", ["x"])
    run("broken")
    failed = spark.read.json(f"{out}/failed").collect()
    assert [(r["task_id"], r["status"]) for r in failed] == [("v", "failed")] and "broken" in spark.read.json(f"{out}/failed_items").first()["error"]
    # the rules' verdict lives for 300 s after it was given, that of new words was learnt later; by 2034 both are over
    _send(given, "d", "w", ["fine words"], "2024-01-01T00:04:59Z")
    _send(given, "e", "x", ["fine words"], "2034-01-01T00:00:00Z")
    run()
    assert items()["w", 0]["from_cache"] is True and items()["x", 0]["from_cache"] is False and len(items()) == 12


def test_stream_rules(spark, one_state, tmp_path):
    """The stream applies the toxicity rules unless told otherwise."""
    given = tmp_path / "in"
    given.mkdir()
    _send(given, "a", "t", ["идиот полный", "добрый день"])
    jobs.moderate(jobs.requests(spark, str(given)), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    got = {r["item_index"]: r for r in jobs.saved_items(spark, str(tmp_path / "out")).collect()}
    assert got[0]["is_toxic"] and got[0]["tox_model_used"] == "regex" and got[0]["toxicity_score"] == 1.0 and not got[1]["is_toxic"]


def test_queue_records(spark):
    value = json.dumps({"task_id": "t", "source": "s", "items": [{"text": "x", "ref": {"chat_id": 1}}], "sent_at": "2024-01-01T00:00:00Z"})
    rows = spark.createDataFrame([(value.encode(),), (b"broken",), (None,), (b"{}",)], "value binary")
    assert [(r["task_id"], r["items"][0]["ref"]["chat_id"]) for r in jobs.parsed_requests(rows).collect()] == [("t", 1)]


def _until(spark, name, n, seconds=90):
    for _ in range(seconds * 2):
        rows = spark.table(name).collect()
        if len(rows) >= n:
            return rows
        time.sleep(0.5)
    raise AssertionError(f"{len(rows)} rows of {n}")


def _feed(spark, folder, schema):
    folder.mkdir()
    return spark.readStream.schema(schema).json(str(folder)), lambda name, lines: (folder / f"{name}.json").write_text("\n".join(map(json.dumps, lines)))


def test_stream_micro_batches(spark, one_state, tmp_path):
    """Batches close by size, by an item that shows their age, and by the first item's timer, which a trickle doesn't put off."""
    rows, put = _feed(spark, tmp_path / "in", "s string, at double, k string")
    put("a", [{"s": "a", "at": t, "k": str(k)} for k, t in enumerate([0.0, 0.1, 0.2, 9.0, 9.1, 9.2])])
    query = jobs.count_or_age(rows, "s", "at", "k", 9, 4.0).writeStream.format("memory").queryName("micro").outputMode("append").start()
    try:
        assert sorted((r["key"], r["batch"]) for r in _until(spark, "micro", 6)) == [("0", 0), ("1", 0), ("2", 0), ("3", 0), ("4", 1), ("5", 1)]
        for k in range(5):  # far fewer than a batch, each sooner after the one before than the timer is long
            put(f"b{k}", [{"s": "b", "at": k / 100, "k": f"b{k}"}])
            time.sleep(2)
        got = [r for r in _until(spark, "micro", 11) if r["source"] == "b"]
        assert sorted(r["key"] for r in got) == [f"b{k}" for k in range(5)] and {0} < {r["batch"] for r in got}
    finally:
        query.stop()


def test_stream_verdict_cache(spark, one_state, tmp_path):
    """Lookups find what was stored while it lives, by the rows' times and by the state's own; lookups don't shorten or prolong it."""
    rows, put = _feed(spark, tmp_path / "in", "key string, asked string, verdict string, ttl_s double, at double")
    put("a", [
        {"key": "a", "asked": "1", "at": 0}, {"key": "a", "verdict": "bad", "ttl_s": 300, "at": 1}, {"key": "a", "asked": "2", "at": 2}, {"key": "b", "asked": "3", "at": 2},
        {"key": "a", "verdict": "good", "ttl_s": 300, "at": 3}, {"key": "a", "asked": "4", "at": 4}, {"key": "a", "asked": "5", "at": 303},
        {"key": "long", "verdict": "kept", "ttl_s": 3600, "at": 1}, {"key": "short", "verdict": "gone", "ttl_s": 2, "at": 1}, {"key": "long", "asked": "6", "at": 2}, {"key": "short", "asked": "7", "at": 2},
    ])
    query = jobs.verdict_cache(rows, short=2, long=3600).writeStream.format("memory").queryName("cached").outputMode("append").start()
    try:
        assert {r["asked"]: r["verdict"] for r in _until(spark, "cached", 7)} == {"1": None, "2": "bad", "3": None, "4": "good", "5": None, "6": "kept", "7": "gone"}
        time.sleep(3)  # the short state's own time is over; the rows' times stand still
        put("b", [{"key": "long", "asked": "8", "at": 2}, {"key": "short", "asked": "9", "at": 2}, {"key": "long", "asked": "10", "at": 3600}, {"key": "long", "asked": "11", "at": 3601}])
        assert {r["asked"]: r["verdict"] for r in _until(spark, "cached", 11) if int(r["asked"]) > 7} == {"8": "kept", "9": None, "10": "kept", "11": None}
    finally:
        query.stop()


def test_update_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda k, t: json.dumps({"update_id": k, "message": {"text": t, "message_id": k, "chat": {"id": 5}, "from": {"id": 6}}, "at": "2024-01-01T00:00:00Z"})
    (tmp_path / "in/a.json").write_text("\n".join([line(1, "x"), line(1, "x"), line(2, " "), line(3, "y")]))
    q = jobs.updates(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("updates").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["update_id"] for r in spark.table("updates").collect()) == [1, 3]


def test_p_values():
    # by the closed form of Student's t with one and two degrees of freedom
    for r in (0.05, 0.5, 0.9, -0.99):
        assert metrics.correlation_p(r, 3) == pytest.approx(1 - 2 / math.pi * math.asin(abs(r)), abs=1e-6)
        assert metrics.correlation_p(r, 4) == pytest.approx(1 - abs(r), abs=1e-9)
    assert metrics.correlation_p(0.0, 10) == 1.0 and metrics.correlation_p(1.0, 10) == 0.0 and metrics.correlation_p(None, 10) is None and metrics.correlation_p(0.5, 2) is None


def test_sources(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.read_corpus(spark, train=DATA)
    pair = tables.read_corpus(spark, train=f"{DATA}/labels.parquet", val=f"{DATA}/labels.parquet")
    assert pair[2] is False and pair[1].count() == pair[0].count()
    runs = spark.createDataFrame([('{"run_tag": "a", "conditions": {"mode": "closed", "other": 1}, "metrics": {"e2e_p50": 2.5}, "note": "x, \\"y\\""}',), ("broken",)], "value string")
    for _ in range(2):
        tables.append_rows(tables.run_rows(runs), f"{tmp_path}/runs")
    back = tables.read_report(spark, f"{tmp_path}/runs", ", ".join(f"{n} {t}" for n, t in tables.run_rows(runs).dtypes))
    assert back.columns == tables.ROW
    assert sorted(map(str, back.select("run_tag", "mode", "e2e_p50", "prefetch", "note").collect())) == sorted([str(r) for r in tables.run_rows(runs).select("run_tag", "mode", "e2e_p50", "prefetch", "note").collect()] * 2)


@pytest.mark.parametrize("name", ["s01_read_corpus", "s05_write_splits", "s06_write_report", "s07_run_rows", "s12_verdict_table", "g_a9_round_trip"])
def test_source_oracles(spark, duck, name):
    test_oracle(spark, duck, name)


def test_round_trip_failures(spark):
    rows = spark.createDataFrame([(1, "da"), (2, " "), (3, None), (4, "x" * 501), (5, "boom")], "doc_id long, text string")

    def there(texts):
        if "boom" in texts:
            raise RuntimeError
        return [t + "1" for t in texts]

    got = {r[0]: tuple(r[1:]) for r in augment.round_trip(rows, there, lambda texts: [t + "2" for t in texts], size=1).collect()}
    assert got == {1: ("da12", "back_translation"), 2: (" ", "original"), 3: ("", "original"), 4: ("x" * 501, "original"), 5: ("boom", "original")}


def test_dual_vocabularies(spark):
    """Capitals words have a vocabulary of their own, case kept."""
    rows = [(k, "ПРИЗ всем" if k % 2 else "приз всем", k % 2) for k in range(20)] + [(99, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = models.fit(frame, "dual", names=[])
    assert {r["term"] for r in model.terms.where("part = 'caps'").collect()} == {" ПР", "ПРИ", "РИЗ", "ИЗ ", " ПРИ", "ПРИЗ", "РИЗ "}
    got = {r[0]: (r[1], r[2]) for r in models.score(model, frame).collect()}
    assert got[99] == (0.0, False) and all(got[k][1] is bool(k % 2) for k in range(20))


def test_rules_planted(spark):
    t = F.col("text")
    toxic = ["перехуярь", "похуй!", "херов", "хер.", "херово", "хули", "ху ня", "трах", "страх", "говно", "дерьмовый", "чисто"]
    got = [r[0] for r in values(spark, toxic, rules.names(rules.categories(t, rules.TOXIC)))]
    assert got == ["", "хуй", "хуй", "хуй", "хуй", "хуй", "хуй", "пиздец", "", "говно", "", ""]
    spam = ["работа без вложений", "без вложенийх", "заработок сразу без вложенийх", "БОНУС за\u00a0регистрацию", "бонус за рег", "жми сюда: ссылка", "жми сюда: ссылк", "пиши в лс", "пиши в лса", "доход от 5", "вывод на карту"]
    got = [r[0] for r in values(spark, spam, rules.names(rules.categories(t, rules.SPAM)))]
    assert got == ["earnings", "", "earnings", "", "earnings", "", "cta_links", "cta_links", "", "earnings", "earnings"]


def test_phone_spaces(spark):
    assert [r[0] for r in values(spark, ["8\u00a0900\u00a0123-45-67"], features.feature("has_phone", F.col("text")))] == [1.0]


def test_corpora_by_suffix(spark, tmp_path):
    frame = spark.createDataFrame([("a, \"b\"\nc", 1, "x")], "text string, label int, other string")
    tables.write_report(frame, f"{tmp_path}/c.csv")
    frame.write.parquet(f"{tmp_path}/c.parquet")
    for name in ("c.csv", "c.parquet"):
        assert [(r["text"], str(r["label"])) for r in tables.read_labelled(spark, f"{tmp_path}/{name}").collect()] == [("a, \"b\"\nc", "1")]
    with pytest.raises(ValueError):
        tables.read_labelled(spark, f"{tmp_path}/c.txt")


def test_validity(spark):
    from textward.operators import relational

    rows = [(1, True, 0.5, "regex", False, 0.0, "tfidf"), (2, None, None, None, False, 0.0, None), (3, True, 1.5, None, None, -0.1, None)]
    items = spark.createDataFrame(rows, "task_id int, is_toxic boolean, toxicity_score double, tox_model_used string, is_spam boolean, spam_score double, spam_model_used string")
    assert [tuple(r) for r in items.orderBy("task_id").select(relational.faults("tox"), relational.faults("spam")).collect()] == [(0, 0), (2, 0), (2, 3)]


def test_verdict_table_buckets(spark, tmp_path):
    """A batch rewrites only the buckets of its keys, and a replay changes nothing."""
    rows = lambda ids, v: spark.createDataFrame([(i, f"{v}", v) for i in ids], "k long, x string, version long")
    path = str(tmp_path / "t")
    tables.save_verdicts(rows(range(50), 0), path, 0, ["k"], "version")
    for _ in range(2):
        out = tables.save_verdicts(rows([3, 60], 1), path, 1, ["k"], "version")
        assert out.count() == 51 and {r["k"] for r in out.where("version = 1").collect()} == {3, 60}
    assert spark.read.parquet(f"{path}/version=1").select("bucket").distinct().count() <= 2


def test_prefix_sum_by_group(spark):
    """Running sums of each group alone, over more ranges than one; an empty table gives none."""
    rows = [(g, float(v), v % 3) for g, n in (("a", 50), ("b", 7), ("c", 1)) for v in range(n)]
    df = spark.createDataFrame(rows, "g string, v double, x long")
    got = {(r["g"], r["v"]): r["run_x"] for r in prefix.prefix_sum_by(df, "g", "v", ["x"], 4).collect()}
    assert got == {(g, v): sum(x for h, w, x in rows if h == g and w >= v) for g, v, _ in rows}
    assert prefix.prefix_sum_by(df.limit(0), "g", "v", ["x"], 4).count() == 0


def test_rule_literals():
    """A literal is in every match, so no pattern is missed; without one a pattern is searched everywhere."""
    cases = {
        "халтурк?а": ["халтур"], r"бл[яеэ]+(?:[тд]ь?)?": ["бл"], "жоп|залуп\\S*".replace("\\\\", "\\"): ["жоп", "залуп"], "а.б": None, "(abc)?xy": ["xy"], r"a\.b": ["a.b"], "colou?r": ["colo"], "x{2}yz": ["yz"],
        "[abc]": None, r"\bword\b": ["word"], "ab+cd": ["ab"], r"\p{L}+ing": ["ing"], "a|bc": None, "(?:a|b)cd|ef": ["cd", "ef"], "КАПС": ["капс"],
    }
    for pattern, want in cases.items():
        assert rule_table.literals(pattern) == want, pattern


def test_rule_table(spark):
    """A thousand rules, and the library's own, give what searching each of them gives."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeабвг") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    table = [(f"r{k:04}", rng.choice([w, w + "?" + rng.choice(words), rng.choice(words) + r"\s+" + w, f"(?:{w}|{rng.choice(words)})x", w + "|" + rng.choice(words), f"[{w}]+" + rng.choice(words)])) for k, w in enumerate(rng.choice(words) for _ in range(1000))]
    table += [(n, p) for n, p in {**rules.TOXIC, **rules.SPAM}.items()]
    texts = [None, "", "  ", "ИДИОТ и халтура", "без   вложений"] + [" ".join(rng.choice([str.upper, str.lower])(rng.choice(words)) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    df = spark.createDataFrame([(k, t, "x", k % 2) for k, t in enumerate(texts)], "doc_id int, text string, name string, label int")
    known = spark.createDataFrame(table, "name string, pattern string")
    compiled = [(n, rule_table.searchable(p)) for n, p in table]
    want = {k: sorted({n for n, p in compiled if t and t.strip() and p.search(t)}) for k, t in enumerate(texts)}
    assert {r["doc_id"]: r["hits"] for r in rule_table.matched(df, known).collect()} == want
    assert "бля" in want[3] and "recruitment" in want[3] and "earnings" in want[4]
    hist = mining.histogram_of_rules(df, known)
    stats = {r["pattern"]: r for r in mining.per_pattern(hist, dict(table)).collect()}
    assert len(stats) == len(table)
    for name in list(dict(table))[:50]:
        own = [k for k in want if name in want[k]]
        assert (stats[name]["hits"], stats[name]["tp"], stats[name]["unique_tp"]) == (len(own), sum(k % 2 for k in own), sum(k % 2 for k in own if len(want[k]) == 1))


def test_greedy_many_patterns(spark):
    """Forty patterns, against trying every pattern at every step."""
    rng = random.Random(7)
    names = [f"p{k:02}" for k in range(40)]
    rows = [(sorted(rng.sample(names, rng.randint(0, 4))), rng.randint(0, 1), rng.randint(1, 5)) for _ in range(150)]
    costs = {n: rng.choice([1.0, 2.0, 3.0]) for n in names}
    chosen, want = [], []
    hit = lambda own, y: sum(n for h, label, n in rows if label == y and set(h) & set(own))
    while True:
        options = []
        for name in set(names) - set(chosen):
            a, b = hit([*chosen, name], 1), hit([*chosen, name], 0)
            if a > hit(chosen, 1) and a / (a + b) >= 0.5:
                options.append((-(a - hit(chosen, 1)) / costs[name], name, a, b))
        if not options:
            break
        _, name, a, b = min(options)
        chosen.append(name)
        want.append((len(chosen), name, a, b))
    hist = spark.createDataFrame(rows, "hits array<string>, label int, n long")
    assert 2 < len(want) and [tuple(r) for r in mining.greedy(hist, dict.fromkeys(names, ""), 0.5, costs).orderBy("step").collect()] == want


def test_update_source_and_result_sink(spark, tmp_path):
    """A query that starts again neither repeats nor loses an update; results go out by batch."""
    given, sent = tmp_path / "in", tmp_path / "out"
    given.mkdir()

    def put(name, ids):
        line = lambda k: json.dumps({"update_id": k, "message": {"text": f"text {k}" if k % 5 else " ", "message_id": k, "chat": {"id": 1}, "from": {"id": 2}}, "at": "2024-01-01T00:00:00Z"})
        (given / f"{name}.json").write_text("\n".join(map(line, ids)))

    def run(seconds, want):
        rows = intake.platform_updates(spark, "textward.streaming.intake:FolderUpdates", path=str(given), limit="4")
        message = rows.select(F.to_json(F.struct("update_id", "text", "ref")).alias("value"))
        q = message.writeStream.format("results").options(client="textward.streaming.intake:FolderResults", path=str(sent)).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            for _ in range(seconds * 2):
                if len(told()) >= want:
                    break
                assert q.exception() is None
                time.sleep(0.5)
        finally:
            q.stop()

    told = lambda: [json.loads(x)["update_id"] for f in sorted(sent.glob("*.json")) for x in f.read_text().splitlines()] if sent.exists() else []
    put("a", range(1, 12))
    run(60, 9)
    assert sorted(told()) == [k for k in range(1, 12) if k % 5]
    put("b", range(12, 18))
    run(60, 14)
    assert sorted(told()) == [k for k in range(1, 18) if k % 5]


def test_update_reader_replays(tmp_path):
    """A batch that was planned before a failure is read again from its offsets alone."""
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"update_id": k}) for k in (3, 4, 6, 9, 10)))
    reader = intake._UpdateReader({"client": "textward.streaming.intake:FolderUpdates", "path": str(tmp_path), "limit": "2"})
    rows, end = reader.read(reader.initialOffset())
    assert [r[0] for r in rows] == [3, 4] and end == {"update_id": 5}
    assert [r[0] for r in reader.readBetweenOffsets({"update_id": 3}, {"update_id": 10})] == [3, 4, 6, 9]
    assert reader.read({"update_id": 11})[1] == {"update_id": 11}


def test_cache_by_hour_and_bucket(spark, tmp_path):
    """A lookup reads the hours that are not over and the buckets it asks for; hours that are over can go."""
    path = str(tmp_path / "cache")
    at = lambda h: datetime(2024, 1, 1, h, tzinfo=timezone.utc)
    rows = [(f"k{k}", f"v{k}", at(k % 3), 3600) for k in range(60)] + [("k1", "newer", at(2), 3600)]
    tables.save_cache(spark.createDataFrame(rows, "key string, verdict string, cached_at timestamp, ttl_s int"), path, 8)
    items = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k3", "c"), ("none", "d"), ("k2", " ")], "key string, text string")
    own = tables.cached(spark, path, items, at(2), 8)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hour" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert 0 < own.count() < 61
    got = {(r["key"], r["text"]): r["verdict"] for r in relational.cache_lookup(items, own, F.lit(at(2))).collect()}
    assert got == {("k1", "a"): "newer", ("k2", "b"): "v2", ("k3", "c"): None, ("none", "d"): None, ("k2", " "): None}
    assert len(tables.drop_expired(spark, path, at(2))) == 1
    assert {r["verdict"] for r in spark.read.parquet(path).collect()} == {r[1] for r in rows if r[2] > at(0)}


def test_fixed_sample(spark):
    df = spark.range(0, 1000)
    got = [r["id"] for r in corpus.sample(df, 50, "id", "s").collect()]
    assert len(set(got)) == 50 and got == [r["id"] for r in corpus.sample(df.repartition(7), 50, "id", "s").collect()] and corpus.sample(df.limit(3), 50, "id", "s").count() == 3
